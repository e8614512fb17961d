"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's ``docs``: documents that the quality classifier
rejects go; of each group of near-duplicates (five-word shingles, similarity of
0.8) one document stays; personal data is replaced by its kind; sources are mixed
to their target weights, a document as often as the mix takes it; texts are
encoded, and what their ids decode to is held against them.  The last stage adds the
columns ``ids``, ``n_tokens`` and ``decoded``, whether decoding gave the text back.

As a stage begins, what earlier ones left in the shared folder is deleted: their
results are written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkloom.llm import bpe, mixing, near_dup, pii, quality
from arkloom.llm.store import cut, sweep


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, doesn't reject."""
    sweep(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels)
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group."""
    sweep(spark)
    return near_dup.deduplicate(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data."""
    sweep(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    sweep(spark)
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    sweep(spark)
    uri = bpe.build(docs, bpe.default_path())
    return bpe.encode(docs, uri, check=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", replace_pii),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: The stages fit models and go round by round, which SQL doesn't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{i}", keep=True)
    return docs
