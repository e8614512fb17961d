"""Running word counts over a folder that grows, as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkloom.functions import text as T


def read_growing(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) so far; for complete or update mode."""
    return rows.select(F.explode(T.tokenise(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(rows: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, count) of tumbling windows; rows later than ``late`` are dropped with their windows' state."""
    w = rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("count"))
    return w.select(F.col("w.start").alias("start"), key, "count")


def into_folder(counts: DataFrame, path: str, marks: str) -> str | None:
    """Runs a complete-mode query over all that is there; each step's rows are written below ``path`` by the executors.

    Returns the folder of the last step, which has the result, or None if there was no step.
    """
    steps: list[str] = []

    def write(rows: DataFrame, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/step-{step}")
        steps.append(f"{path}/step-{step}")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return steps[-1] if steps else None
