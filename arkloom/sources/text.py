"""Delimited text without quotes, quoted CSV, whole text files, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """Fields between ``sep``, quotes being ordinary characters; without a schema, one array a line."""
    if schema:
        return spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path)
    return spark.read.text(path).where("value <> ''").select(F.split("value", f"\\Q{sep}\\E", -1).alias("fields"))


def write_delimited(df: DataFrame, path: str, sep: str = ",", compression: str | None = None) -> None:
    """Lines of all columns (arrays spread out), unquoted; an existing path is an error."""
    parts = [F.array_join(F.col(f.name).cast("array<string>"), sep, "") if f.dataType.typeName() == "array" else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in df.schema]
    out = df.select(F.concat_ws(sep, *parts).alias("value")).write
    (out.option("compression", compression) if compression else out).text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV; a doubled quote is a quote."""
    return spark.read.schema(schema).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_text_tree(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of the text files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def as_warc(files: DataFrame) -> DataFrame:
    """WARC resource records of rows (path, text); the length is that of the lines, each with its end."""
    name = F.concat(F.lit("file:///"), F.regexp_extract("path", r"([^/]*)$", 1))
    body = F.concat(F.array_join(F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n"), "\n"), F.lit("\n"))
    heads = F.create_map(F.lit("Content-Type"), F.lit("text/plain"))
    return files.select(
        name.alias("warcRecordId"),
        F.octet_length(body).alias("contentLength"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.lit("resource").alias("warc_type"),
        heads.alias("optionalHeaderFlds"),
        body.cast("binary").alias("content"),
    )
