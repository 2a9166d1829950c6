"""Reports as tables: draw lists, legends, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def draw_list(attributes: DataFrame, findings: DataFrame) -> DataFrame:
    """What to draw, in z order: attribute boxes (green, red where kept as a pair), then finding boxes."""
    a = attributes.select("drawing_id", F.lit(1).alias("z"), F.when(F.col("keep_pair"), "overlap").otherwise("attribute").alias("kind"), "x1", "y1", "x2", "y2", F.when(F.col("keep_pair"), "#dc1e1e").otherwise("#1ea01e").alias("color"))
    f = findings.select("drawing_id", F.lit(3).alias("z"), F.lit("finding").alias("kind"), "x1", "y1", "x2", "y2", F.lit("#ff0000").alias("color"))
    return a.unionByName(f)


def svg(drawn: DataFrame, width: int, height: int) -> DataFrame:
    """One SVG text per drawing."""
    rect = F.format_string('<rect x="%d" y="%d" width="%d" height="%d" fill="none" stroke="%s"/>', "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "color")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", rect.alias("r")))), lambda x: x["r"]), "\n")
    return drawn.groupBy("drawing_id").agg(F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">\n'), body, F.lit("\n</svg>")).alias("svg"))


def legend(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("drawing_id").agg(F.count_if(~F.col("keep_pair")).alias("n_ok"), F.count_if("keep_pair").alias("n_overlap"))
    plural = lambda n: F.when(F.col(n) > 1, F.concat(F.lit("（"), F.col(n).cast("string"), F.lit("处）"))).otherwise("")
    return out.withColumn("label", F.concat(F.lit("OK"), plural("n_ok"), F.lit(" / overlap"), plural("n_overlap")))


def markdown(drawings: DataFrame, findings: DataFrame) -> DataFrame:
    """(drawing_id, markdown): a head, and a table of findings or the line that there are none."""
    line = F.concat_ws(" | ", F.lit("|").alias("e"), "rule_id", "severity", "message")
    body = findings.groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    head = F.concat(F.lit("# "), F.col("drawing_id").cast("string"), F.lit("\n"))
    return drawings.join(body, "drawing_id", "left").select("drawing_id", F.concat(head, F.coalesce("body", F.lit("无违规项。"))).alias("markdown"))
