from pyspark.sql import functions as F

from arkloom.plans import io_queries
from arkloom.streaming import counts as live


def test_steps_are_written_by_executors(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"cat dog{i}",)], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    words = live.running_counts(live.read_growing(spark, str(tmp_path / "in"), "text string", 1))
    last = live.into_folder(words, str(tmp_path / "out"), str(tmp_path / "marks"))
    steps = len(list((tmp_path / "out").iterdir()))
    assert steps >= 3 and last.endswith(f"step-{steps - 1}")
    assert {r["word"]: r["count"] for r in spark.read.parquet(last).collect()} == {"cat": 3, "dog0": 1, "dog1": 1, "dog2": 1}


def test_query_keeps_no_table_in_the_driver(spark):
    found = io_queries.streaming_counts(spark, "/root/testdata/sf0.001")
    assert found.agg(F.count("word")).first()[0] > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("counts_")]
