"""State kept in tables: the perception cache, the review log, rule versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signature(ingest_sig, content):
    """16 hex digits of the ingest signature, else of the content."""
    return F.substring(F.sha1(F.coalesce(ingest_sig.cast("binary"), content.cast("binary"))), 1, 16)


def plan_key(*columns):
    return F.substring(F.sha1(F.to_json(F.struct(*columns)).cast("binary")), 1, 16)


def hits(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache, keys)


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache, keys, "left_anti")


def append(rows: DataFrame, path: str, partition: str = "backend") -> None:
    """Adds cache rows; a table by backend."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


def enqueue(results: DataFrame, enqueue_warn: bool = True) -> DataFrame:
    """What goes to review: failed, in doubt (n_review) or warned (n_warn, if there is such a column); with
    enqueue_warn all, clean ones too."""
    warned = F.col("n_warn") > 0 if "n_warn" in results.columns else F.lit(False)
    due = F.lit(True) if enqueue_warn else ~F.col("passed") | (F.col("n_review") > 0) | warned
    return results.filter(due).withColumn("status", F.lit("pending"))


#: Fixed values.
DECISIONS = ("approve", "reject", "revise")


def resolve(items: DataFrame, decisions: DataFrame, key: str = "drawing_id") -> DataFrame:
    """items with status, decision, reviewer and comment after decisions (key, decision, reviewer, comment); an
    unknown decision is an error. Items without one stay as they are."""
    d = decisions.select(F.col(key).alias("of"), F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), F.coalesce("decision", F.lit("null"))))).alias("decision"), F.coalesce("reviewer", F.lit("human")).alias("reviewer"), F.coalesce("comment", F.lit("")).alias("comment"))
    kept = items.drop("decision", "reviewer", "comment")
    out = kept.join(d, F.col(key) == F.col("of"), "left")
    return out.withColumn("status", F.when(F.col("decision").isNotNull(), "resolved").otherwise(F.col("status"))).drop("of")


def pending(items: DataFrame) -> DataFrame:
    return items.filter("status = 'pending'")


def in_doubt(instances: DataFrame) -> DataFrame:
    """(drawing_id, entity_id) of entities with an instance that needs review."""
    return instances.filter("needs_review").select("drawing_id", "entity_id").distinct()


def latest(log: DataFrame, key: str = "drawing_id") -> DataFrame:
    """The last event of each item."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("m")).select(key, "m.*")


def next_versions(rules: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts with the version they get: one after the last, or 1."""
    last = rules.groupBy("rule_id").agg(F.max("version").alias("last"))
    return drafts.join(last, "rule_id", "left").select("rule_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"))
