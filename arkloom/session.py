"""A session with this library's defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def session(name: str = "arkloom", **conf) -> SparkSession:
    """Adaptive execution, UTC and Kryo; master and sizes are the cluster's to say."""
    b = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.serializer": "org.apache.spark.serializer.KryoSerializer"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; a local session without it has a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="arkloom-")
        named = f"file://{_local[app]}"
    return f"{named.rstrip('/')}/arkloom-work/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to such a folder and read again: what isn't stable from run to run is fixed, and computed once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
