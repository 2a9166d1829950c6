"""What workers and tasks of the corpus pipeline hold."""

import collections

from draftlens.llm import common, mixing
from pyspark.sql import functions as F


def test_mix_files_hold_one_shard(spark, monkeypatch):
    """Each shard is a partition of its own, of some SHARD_WORDS words, so that no task sorts, writes or reads several."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 10_000)
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 30 + 1).cast("int")).alias("text"))
    of = collections.Counter(s for r in mixing.mix(big).collect() for s in r.shards)
    parts = mixing.shuffled(big).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert {r.p: r["count"] for r in parts} == of and len(of) > 8
    monkeypatch.undo()
    assert mixing.SHARD_WORDS * 7 <= 40_000_000  # bytes of text that a task holds


def test_few_rows_need_no_python_worker(spark):
    got = common.few_rows(spark, [(1, "a", None), (2, None, 0.5)], "i int, of string, x double")
    assert [tuple(r) for r in got.collect()] == [(1, "a", None), (2, None, 0.5)] and got.dtypes == [("i", "int"), ("of", "string"), ("x", "double")]
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
    assert common.few_rows(spark, [], "i int").count() == 0
    assert [r.of for r in common.few_rows(spark, [(b"x",), (None,)], "of binary").collect()] == [b"x", None]


def test_workers_let_go_of_another_operators_state():
    made = []
    make = lambda: made.append(1) or object()
    first = common.kept("a", "k", make)
    assert list(common.trimmed(iter, "a")([1])) == [1] and common.kept("a", "k", make) is first
    assert list(common.trimmed(iter)([2])) == [2] and ("a", "k") not in common._held
    assert common.kept("a", "k", make) is not first and len(made) == 2
    common.let_go(None)
