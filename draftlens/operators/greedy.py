"""Operators that take boxes in order and keep what the kept ones allow.

Each is an aggregate over a group's sorted array: sequential by nature, but inside one row, with
no Python. A group is one drawing's boxes (of one entity), which a page bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, inside, iou


def keep_greedily(rows: DataFrame, keys: list[str], clashes: Callable[[Column, Column], Column], carry: tuple[str, ...] = ()) -> DataFrame:
    """By confidence, then iid: a row stays unless it clashes(kept, row) with one that stayed."""
    item = F.struct((-F.col("conf")).alias("rank"), "iid", "x1", "y1", "x2", "y2", *carry)
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("l"))
    kept = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clashes(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return gathered.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.iid")


def nms(rows: DataFrame, iou_thr: float = 0.5) -> DataFrame:
    """Per entity: a box goes if its IoU with a kept one reaches iou_thr."""
    return keep_greedily(rows, ["drawing_id", "entity_id"], lambda k, x: iou(Box.of(k), Box.of(x)) >= iou_thr)


def dedupe(rows: DataFrame, iou_thr: float = 0.85) -> DataFrame:
    """The same across entities."""
    return keep_greedily(rows, ["drawing_id"], lambda k, x: iou(Box.of(k), Box.of(x)) >= iou_thr)


#: Fixed values of clustering.
TALL, WIDE, TALLER = 1.35, 1.8, 1.2
INSIDE_IOU, INSIDE_AREA = 0.12, 0.35
NEAR, NEAR_TURNED, TURNED, LEAST_SIDE = 0.45, 1.1, 80, 8


def near_duplicate(k: Column, x: Column, iou_thr: float = 0.35) -> Column:
    """Whether candidate x repeats the kept k. Much in common does; else, where a centre lies in the other box, only
    that decides: x in k by some common share or by not being small, k in x by some common share; else centres close
    for the longest side, or not so close if both texts are turned. A tall x is never a lower, wide k's repetition.
    k and x have the box and the angle of their text."""
    a, b = Box.of(k), Box.of(x)
    aw, ah, bw, bh = (F.greatest(F.lit(1), side) for side in (a.width, a.height, b.width, b.height))
    share = iou(a, b)
    dx, dy = b.cx - a.cx, b.cy - a.cy
    apart, longest = F.sqrt(dx * dx + dy * dy), F.greatest(aw, ah, bw, bh, F.lit(LEAST_SIDE))
    turned = (F.abs(F.coalesce(k["angle"], F.lit(0.0))) >= TURNED) & (F.abs(F.coalesce(x["angle"], F.lit(0.0))) >= TURNED)
    return (
        F.when((bh >= TALL * bw) & (aw >= WIDE * ah) & (bh > TALLER * ah), False)
        .when(share >= iou_thr, True)
        .when(inside(b.cx, b.cy, a), (share >= INSIDE_IOU) | (bw * bh > INSIDE_AREA * aw * ah))
        .when(inside(a.cx, a.cy, b), share >= INSIDE_IOU)
        .otherwise((apart < NEAR * longest) | (turned & (apart < NEAR_TURNED * longest)))
    )


def cluster(rows: DataFrame, iou_thr: float = 0.35) -> DataFrame:
    """rows with an angle (of the page's turning, or else of the text; null counts as 0)."""
    return keep_greedily(rows.withColumn("angle", F.col("angle").cast("double")), ["drawing_id"], lambda k, x: near_duplicate(k, x, iou_thr), ("angle",))


def match(preds: DataFrame, truths: DataFrame, iou_thr: float = 0.5) -> DataFrame:
    """(drawing_id, entity_id, tp, fp, fn): predictions in order each take the best free truth, the first
    of equals, if it reaches iou_thr."""
    keys = ["drawing_id", "entity_id"]
    item = F.struct("iid", "x1", "y1", "x2", "y2")
    p = preds.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("p"))
    t = truths.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("t"))
    none = F.array().cast(p.schema["p"].dataType)
    both = p.join(t, keys, "full").withColumns({"p": F.coalesce("p", none), "t": F.coalesce("t", none)})

    def best(taken: Column, x: Column) -> Column:
        free = F.filter("t", lambda y: ~F.array_contains(taken, y["iid"]) & (iou(Box.of(y), Box.of(x)) >= iou_thr))
        return F.array_max(F.transform(free, lambda y: F.struct(iou(Box.of(y), Box.of(x)).alias("iou"), (-y["iid"]).alias("first"))))["first"]

    taken = F.aggregate("p", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.filter(F.array(-best(acc, x)), lambda i: i.isNotNull())))
    return both.select(*keys, F.size(taken).alias("tp"), "p", "t").select(*keys, "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("t") - F.col("tp")).alias("fn"))


def merge_twins(rows: DataFrame) -> DataFrame:
    """(drawing_id, parent, x1, y1, x2, y2, n): rows whose parent_id differs by a _twin ending at most, as one box."""
    return rows.groupBy("drawing_id", F.regexp_replace("parent_id", "_twin$", "").alias("parent")).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))


def merge_by_iou(rows: DataFrame, least: float = 0.05) -> DataFrame:
    """(drawing_id, iid, x1, y1, x2, y2, n): boxes without parents, in order: each that is still free takes the free
    one after it with the largest IoU (the first of equals), if that reaches `least`, and becomes their common box."""
    item = F.struct("iid", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    lists = rows.groupBy("drawing_id").agg(F.array_sort(F.collect_list(item)).alias("l"))

    def best(taken: Column, x: Column) -> Column:
        free = F.filter("l", lambda y: (y["iid"] > x["iid"]) & ~F.array_contains(taken, y["iid"]) & (iou(Box.of(y), Box.of(x)) >= least))
        return F.array_max(F.transform(free, lambda y: F.struct(iou(Box.of(y), Box.of(x)).alias("iou"), (-y["iid"]).alias("first"))))["first"]

    none = F.array().cast("array<bigint>")
    # Two entries a step, the box and its partner (itself if none); a box that is a partner has no step.
    steps = F.aggregate("l", none, lambda acc, x: F.when(F.array_contains(acc, x["iid"]), acc).otherwise(F.concat(acc, F.array(x["iid"], F.coalesce(-best(acc, x), x["iid"])))))
    each = lists.select("drawing_id", "l", F.posexplode(steps).alias("p", "iid"))
    heads = each.select("drawing_id", F.floor(F.col("p") / 2).alias("pair"), F.filter("l", lambda y: y["iid"] == F.col("iid"))[0].alias("b"))
    grouped = heads.groupBy("drawing_id", "pair").agg(F.min("b.iid").alias("iid"), F.min("b.x1").alias("x1"), F.min("b.y1").alias("y1"), F.max("b.x2").alias("x2"), F.max("b.y2").alias("y2"), F.count_distinct("b.iid").alias("n"))
    return grouped.drop("pair")


#: Page angles that are read anyway.
UPRIGHT = (0, 90, -90)


def extra_angles(angles: DataFrame, existing: tuple[int, ...] = (), step: int = 15, min_count: int = 2, most: int = 4) -> DataFrame:
    """(drawing_id, angle): page angles worth reading besides upright, both ways on its side, and the
    existing ones, by how often text leans so."""
    from ..functions.angle import bucket, normalize

    lean = angles.filter(F.abs("angle").between(12, 78)).select("drawing_id", "iid", bucket(F.col("angle"), step).alias("bucket"))
    counts = lean.groupBy("drawing_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("iid").alias("first")).filter(F.col("n") >= min_count)
    ranked = counts.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", (-F.col("bucket")).alias("angle")))).alias("l"))
    known = F.array(*[normalize(F.lit(float(x))) for x in dict.fromkeys((*UPRIGHT, *existing))])
    added = F.aggregate("l", F.array().cast("array<int>"), lambda acc, x: F.when(F.exists(F.concat(known, acc.cast("array<double>")), lambda k: F.abs(k - x["angle"]) < step / 2) | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(x["angle"]))))
    return ranked.select("drawing_id", F.explode(added).alias("angle"))
