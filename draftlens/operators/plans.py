"""Perception plans, facts and evaluation: grouping, merging, routing, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import stripped


def merge_plans(entries: DataFrame, scalars: tuple[str, ...]) -> DataFrame:
    """entries: entity_id, locate_query, seq and scalars. One row per key; of each scalar the last that isn't null."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in scalars]
    return entries.filter(F.col("entity_id").isNotNull()).groupBy("entity_id", "locate_query").agg(*last, F.min("seq").alias("seq"))


def collect_entities(fields: DataFrame) -> DataFrame:
    """fields: entity_id, locate_query, seq, cardinality, field, parse_hint, required. Per field the last hint
    that isn't blank and whether any asks for it; the entity's first cardinality."""
    key = ["entity_id", "locate_query"]
    first = fields.groupBy(*key).agg(F.min_by("cardinality", "seq").alias("cardinality"))
    hint = F.nullif(F.col("parse_hint"), F.lit(""))
    per = fields.groupBy(*key, "field").agg(F.max_by(hint, F.when(hint.isNotNull(), F.col("seq"))).alias("parse_hint"), F.bool_or("required").alias("required"))
    return per.join(first, key)


def is_table(entity_id: Column, parse_kind: Column) -> Column:
    return F.coalesce(F.lower(parse_kind) == "table", F.lit(False)) | F.coalesce(entity_id.rlike("_table$"), F.lit(False))


def route(entity_id: Column, parse_kind: Column, backend: Column) -> Column:
    """ocr or vl."""
    marks = F.coalesce(parse_kind == "dimension_marks", F.lit(False))
    return F.when(marks & ~F.coalesce(backend == "ocr", F.lit(False)), "vl").when(entity_id.isin("number_mark", "annotation", "annotations") | marks, "ocr").otherwise("vl")


def missing_required(plan: DataFrame, instances: DataFrame) -> DataFrame:
    """(drawing_id, entity_id) of planned entities without one instance that has a box and all required fields.
    plan: drawing_id, entity_id; instances: drawing_id, entity_id, x1..y2, complete."""
    placed = ~((F.col("x1") == 0) & (F.col("y1") == 0) & (F.col("x2") == 0) & (F.col("y2") == 0))
    found = instances.groupBy("drawing_id", "entity_id").agg(F.bool_or(placed & F.col("complete")).alias("found"))
    return plan.join(found, ["drawing_id", "entity_id"], "left").filter(~F.coalesce("found", F.lit(False))).select("drawing_id", "entity_id")


def hybrid(primary: DataFrame, fallback: DataFrame, missing: DataFrame) -> DataFrame:
    """The primary rows of entities that aren't missing, and the fallback's rows of those that are."""
    keys = ["drawing_id", "entity_id"]
    return primary.join(missing, keys, "left_anti").unionByName(fallback.join(missing, keys, "left_semi"))


def exclude_regions(tables: DataFrame, width: int, height: int, pad: int = 2, up: float = 0.12) -> DataFrame:
    """A clamped, padded box per table (material ones reach up) and one about all of a drawing's."""
    tall = F.when(F.col("material"), F.lit(int(up * height))).otherwise(F.lit(0))
    box = g.Box(F.greatest(F.lit(0), F.col("x1") - pad), F.greatest(F.lit(0), F.col("y1") - pad - tall), F.least(F.lit(width), F.col("x2") + pad), F.least(F.lit(height), F.col("y2") + pad))
    each = tables.filter("x2 > x1 and y2 > y1").select("drawing_id", "iid", box.x1.alias("x1"), box.y1.alias("y1"), box.x2.alias("x2"), box.y2.alias("y2"))
    grouped = each.groupingSets([["drawing_id", "iid"], ["drawing_id"]], "drawing_id", "iid")
    return grouped.agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def numbered(instances: DataFrame, order: str = "iid") -> DataFrame:
    """instance_id: the entity and a running number from 0."""
    w = Window.partitionBy("drawing_id", "entity_id").orderBy(order)
    return instances.withColumn("instance_id", F.concat("entity_id", F.lit("#"), (F.row_number().over(w) - 1).cast("string")))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 for empty denominators."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def rule_sets(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(drawing_id, tp, fp, fn) of rule ids."""
    both = expected.withColumn("e", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), ["drawing_id", "rule_id"], "full")
    return both.groupBy("drawing_id").agg(F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def field_match(pred: Column, truth: Column) -> Column:
    """Both null, or the same but for white space at the ends."""
    return stripped(pred.cast("string")).eqNullSafe(stripped(truth.cast("string")))


def tiles(pages: DataFrame, size: int = 1280, overlap: float = 0.2) -> DataFrame:
    """Tiles (x1, y1, x2, y2) of pages with width and height: one if the page fits, else a grid with overlap
    that stops at the edge."""
    step = max(1, int(size * (1 - overlap)))
    starts = lambda side: F.filter(F.sequence(F.lit(0), F.greatest(F.col(side) - 1, F.lit(0)), F.lit(step)), lambda x: (x == 0) | (x - step + size < F.col(side)))
    small = F.greatest("width", "height") <= size
    one = F.array(F.lit(0))
    out = pages.withColumn("x1", F.explode(F.when(small, one).otherwise(starts("width")))).withColumn("y1", F.explode(F.when(small, one).otherwise(starts("height"))))
    return out.withColumns({"x2": F.least("width", F.col("x1") + size), "y2": F.least("height", F.col("y1") + size)})


def twins(rows: DataFrame, share: float = 0.72, rest: float = 0.28) -> DataFrame:
    """Each overlap box as two, split along its longer side: the first has `share` of it, the second
    starts after `rest`; sides count as two pixels at least."""
    b = g.Box("x1", "y1", "x2", "y2")
    w, h = F.greatest(F.lit(2), b.width), F.greatest(F.lit(2), b.height)
    tall = h >= w
    cut = lambda side: F.greatest(F.lit(2), (side * share).cast("int"))
    lead = lambda side: (side * rest).cast("int")
    first = F.when(tall, F.struct(b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), (b.y1 + cut(h)).alias("y2"))).otherwise(F.struct(b.x1.alias("x1"), b.y1.alias("y1"), (b.x1 + cut(w)).alias("x2"), b.y2.alias("y2")))
    second = F.when(tall, F.struct(b.x1.alias("x1"), (b.y1 + lead(h)).alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))).otherwise(F.struct((b.x1 + lead(w)).alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2")))
    return rows.select("drawing_id", "iid", F.posexplode(F.array(first, second)).alias("twin", "t")).select("drawing_id", F.concat(F.col("iid").cast("string"), F.when(F.col("twin") == 1, "_twin").otherwise("")).alias("parent_id"), "t.*")


def boundary(pairs: DataFrame, height: int, gap: int = 2, min_main: int = 80) -> DataFrame:
    """pairs: material box m_*, main box n_* of a drawing on a page of that height. Boxes that stand upside
    down, by over 10 pixels at the top and not 10 short at the bottom, swap. The material box ends where the
    main one keeps its height (min_main at least), the main one starts below it; one that is left too low
    grows down the page, or up if there is no page left."""
    flip = (F.col("m_y1") > F.col("n_y1") + 10) & (F.col("m_y2") > F.col("n_y2") - 10)
    pick = lambda c, a, b: F.when(flip, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}"))
    rows = pairs.select("drawing_id", *[pick(c, "m", "n").alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")], *[pick(c, "n", "m").alias(f"n_{c}") for c in ("x1", "y1", "x2", "y2")])
    kept = F.greatest(F.lit(min_main), F.col("n_y2") - F.col("n_y1"))
    rows = rows.withColumn("kept", kept).withColumn("most", F.greatest(F.col("m_y1") + 8, F.col("n_y2") - F.col("kept") - gap))
    rows = rows.withColumn("m_y2", F.when(F.col("m_y2") > F.col("most"), F.greatest(F.col("m_y1") + 4, "most")).otherwise(F.col("m_y2")))
    rows = rows.withColumn("n_y1", F.greatest("n_y1", F.col("m_y2") + gap))
    low = F.col("n_y2") - F.col("n_y1") < min_main
    rows = rows.withColumn("n_y2", F.when(low, F.least(F.lit(height), F.col("n_y1") + F.col("kept"))).otherwise(F.col("n_y2")))
    rows = rows.withColumn("n_y1", F.when(F.col("n_y1") >= F.col("n_y2") - 4, F.greatest(F.lit(0), F.col("n_y2") - min_main)).otherwise(F.col("n_y1")))
    return rows.withColumns({"n_y1": F.greatest(F.lit(0), "n_y1"), "n_y2": F.least(F.lit(height), "n_y2"), "y1_floor": F.col("m_y2") + gap}).drop("kept", "most")


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("passed").agg(F.count(F.lit(1)).alias("n"), F.sum("n_findings").cast("long").alias("n_findings"))
