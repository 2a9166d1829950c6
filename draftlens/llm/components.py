"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every end of the links (u, v): label is the same all over a component.

    Each step lets every label take its smallest neighbour, follows those pointers to their ends
    and drops links inside one label. Links never leave the executors; a step is written to the
    shared folder, so none is computed twice, and goes when the next one stands.
    """
    edges = written(links.filter("u != v").distinct(), "edges")
    labels = written(links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = written(both.groupBy("u").agg(F.min("v").alias("p")).filter("p < u"), "pointers")
        while True:
            far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            further = up.select(F.col("u").alias("q"), F.col("p").alias("r"))
            stepped = up.join(far, "p", "left").join(further, "q", "left")
            jumped = written(stepped.select("u", F.coalesce("r", "q", "p").alias("p"), F.col("r").isNotNull().alias("moved")), "pointers")
            forget(up)
            up = jumped
            if jumped.filter("moved").isEmpty():
                break
        moved = written(labels.join(up.select(F.col("u").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        u, v = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")).filter("u != v")
        left = written(left.distinct(), "edges")
        forget(labels, edges, up)
        labels, edges = moved, left
    forget(edges)
    return labels
