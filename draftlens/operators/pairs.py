"""Joins between boxes of one drawing: pairs, containment, tokens, labels.

Boxes go to the grid cells they cover, and drawing and cell are the equi-key, so the work follows the
boxes that are near each other, not a drawing's pairs; a pair is taken in the cell of its common
corner, so nothing is met twice. The exact condition is the join's residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx

BOX = ("x1", "y1", "x2", "y2")


def sides(boxes: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """boxes twice, columns led by a_ and b_; both keep drawing_id."""
    cols = ["iid", *BOX, *keep]
    return tuple(boxes.select("drawing_id", *[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "ab")


def box(prefix: str) -> g.Box:
    return g.Box(*[f"{prefix}_{c}" for c in BOX])


CELL = 100


def celled(rows: DataFrame, b: g.Box, pad: float = 0, cell: int = CELL) -> DataFrame:
    """rows once for each grid cell (cell_x, cell_y) that their box covers, with pad around it."""
    at = lambda v: F.floor(v / cell)
    wide = rows.withColumn("cell_x", F.explode(F.sequence(at(b.x1 - pad), at(F.greatest(b.x1 - pad, b.x2 + pad)))))
    return wide.withColumn("cell_y", F.explode(F.sequence(at(b.y1 - pad), at(F.greatest(b.y1 - pad, b.y2 + pad)))))


def at_home(a: g.Box, b: g.Box, pad: float = 0, cell: int = CELL) -> Column:
    """Whether this cell is the one of the common corner of a, with pad around it, and b."""
    return (F.col("cell_x") == F.floor(F.greatest(a.x1 - pad, b.x1) / cell)) & (F.col("cell_y") == F.floor(F.greatest(a.y1 - pad, b.y1) / cell))


KEYS = ["drawing_id", "cell_x", "cell_y"]


def overlapping(boxes: DataFrame, min_intersection: float = 1, iou_thr: float = 0, min_ratio: float = 0, min_side: float = 0, only_keep_pair: bool = False, skip_neighbors: bool = False, cell: int = CELL) -> DataFrame:
    """(drawing_id, a, b, inter) of overlapping boxes, a < b, with min_intersection (over 0) or more in common."""
    rows = boxes.filter(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= min_side)
    if only_keep_pair:
        rows = rows.filter("keep_pair")
    left, right = sides(rows, *(["keep_pair"] if skip_neighbors else []))
    a, b = box("a"), box("b")
    hit = (F.col("a_iid") < F.col("b_iid")) & (g.intersection(a, b) >= min_intersection) & at_home(a, b, cell=cell)
    if iou_thr:
        hit = hit & (g.iou(a, b) >= iou_thr)
    if min_ratio:
        hit = hit & (g.small_ratio(a, b) >= min_ratio)
    if skip_neighbors:
        hit = hit & ~(g.horizontal_neighbors(a, b) & ~(F.col("a_keep_pair") & F.col("b_keep_pair")))
    met = celled(left, a, cell=cell).join(celled(right, b, cell=cell), KEYS)
    return met.filter(hit).select("drawing_id", F.col("a_iid").alias("a"), F.col("b_iid").alias("b"), g.intersection(a, b).cast("long").alias("inter"))


def touching(boxes: DataFrame, pad: int = 2) -> DataFrame:
    left, right = sides(boxes)
    a, b = box("a"), box("b")
    met = celled(left, a, pad).join(celled(right, b), KEYS)
    return met.filter((F.col("a_iid") < F.col("b_iid")) & g.touch(a, b, pad) & at_home(a, b, pad)).select("drawing_id", F.col("a_iid").alias("a"), F.col("b_iid").alias("b"))


def outside(rows: DataFrame, regions: DataFrame, pad: int = 0) -> DataFrame:
    """Rows whose centre lies in none of their drawing's regions."""
    b, r = g.Box(*BOX), box("r")
    near = celled(regions.select(F.col("drawing_id").alias("rd"), *[F.col(c).alias(f"r_{c}") for c in BOX]), r, pad)
    same = (F.col("drawing_id") == F.col("rd")) & (F.floor(b.cx / CELL) == F.col("cell_x")) & (F.floor(b.cy / CELL) == F.col("cell_y"))
    return rows.join(near, same & g.inside(b.cx, b.cy, r, pad), "left_anti")


def not_overlapping(rows: DataFrame, others: DataFrame, iou_thr: float) -> DataFrame:
    """Rows without an IoU over iou_thr (0 or more) with any of the others of their drawing. iid tells rows apart."""
    left, right = rows.select("drawing_id", *[F.col(c).alias(f"a_{c}") for c in ("iid", *BOX)]), others.select("drawing_id", *[F.col(c).alias(f"b_{c}") for c in BOX])
    a, b = box("a"), box("b")
    met = celled(left, a).join(celled(right, b), KEYS).filter((g.iou(a, b) > iou_thr) & at_home(a, b))
    return rows.join(met.select("drawing_id", F.col("a_iid").alias("iid")).distinct(), ["drawing_id", "iid"], "left_anti")


def without_tokens(rows: DataFrame, tokens: DataFrame, text: str = "txt") -> DataFrame:
    """Rows whose text matches none of their drawing's table tokens (drawing_id, token)."""
    t = tokens.select(F.col("drawing_id").alias("td"), "token")
    return rows.join(t, (F.col("drawing_id") == F.col("td")) & tx.matches_token(F.col(text), F.col("token")), "left_anti")


def labels_above(values: DataFrame, labels: DataFrame, most_gap: int = 100, least_overlap: float = 0.25) -> DataFrame:
    """Each value with the nearest label below it in its column; ties go to the first label. Cells are
    columns of the page and bands of most_gap, of which a value looks at two."""
    left = values.select("drawing_id", F.col("iid").alias("v_iid"), *[F.col(c).alias(f"v_{c}") for c in BOX])
    right = labels.select("drawing_id", F.col("iid").alias("l_iid"), *[F.col(c).alias(f"l_{c}") for c in BOX])
    columns = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}_x1") / CELL), F.floor(F.greatest(f"{p}_x1", f"{p}_x2") / CELL)))
    band = lambda v: F.floor(F.col(v) / (most_gap + 1))
    left = left.withColumn("cell_x", columns("v")).withColumn("cell_y", F.explode(F.array(band("v_y2"), band("v_y2") + 1)))
    right = right.withColumn("cell_x", columns("l")).withColumn("cell_y", band("l_y1"))
    gap = F.col("l_y1") - F.col("v_y2")
    met = left.join(right, KEYS).filter(gap.between(0, most_gap) & (g.x_overlap(box("v"), box("l")) >= least_overlap))
    return met.groupBy("drawing_id", "v_iid").agg(F.min(F.struct(gap.alias("gap"), F.col("l_iid").alias("label"))).alias("m")).select("drawing_id", F.col("v_iid").alias("iid"), F.col("m.label").alias("label"), F.col("m.gap").alias("gap"))


def references(rows: DataFrame, targets: DataFrame, ref: Column, how: str = "left_semi") -> DataFrame:
    """Rows whose reference names an object (targets: drawing_id, id) of their drawing."""
    t = targets.select(F.col("drawing_id").alias("td"), "id")
    return rows.join(t, (F.col("drawing_id") == F.col("td")) & (ref == F.col("id")), how)


def evidence_boxes(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of overlap pairs, once by value, in the order they are first met: (drawing_id, rank, id, box)."""
    ends = pairs.select("drawing_id", "a", "b", F.posexplode(F.array("a", "b")).alias("side", "iid"))
    full = ends.join(boxes.select("drawing_id", "iid", *BOX), ["drawing_id", "iid"])
    first = Window.partitionBy("drawing_id", *BOX).orderBy("a", "b", "side")
    once = full.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return once.select("drawing_id", F.row_number().over(Window.partitionBy("drawing_id").orderBy("a", "b", "side")).alias("rank"), "iid", *BOX)
