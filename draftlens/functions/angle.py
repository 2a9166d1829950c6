"""Text angles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box


def normalize(degrees: Column) -> Column:
    """Into (-90, 90], to a tenth."""
    return F.round(90 - F.pmod(90 - degrees, F.lit(180.0)), 1)


def from_box(box: Box) -> Column:
    """90 for boxes clearly taller than wide, else 0."""
    return F.when(F.greatest(F.lit(1), box.height) >= 1.35 * F.greatest(F.lit(1), box.width), F.lit(90.0)).otherwise(F.lit(0.0))


def from_quad(quad: Column) -> Column:
    """The direction of the longest edge, the first of equals; 0 for under two points."""
    n = F.size(quad)

    def edge(p, i):
        q = F.get(quad, F.pmod(i + 1, n))
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        return F.struct((dx * dx + dy * dy).alias("length"), (-i).alias("first"), F.degrees(F.atan2(dy, dx)).alias("angle"))

    return F.when(n >= 2, normalize(F.array_max(F.transform(quad, edge))["angle"])).otherwise(F.lit(0.0))


def of_instance(field_angle: Column, angle: Column, box: Box) -> Column:
    """The field's angle, else the instance's, else the box's estimate; what isn't a number falls through."""
    number = lambda c: F.expr("null").cast("double") if c is None else c.try_cast("double")
    return normalize(F.coalesce(number(field_angle), number(angle), from_box(box)))


def bucket(angle: Column, step: int = 15) -> Column:
    return (F.bround(angle / step) * step).cast("int")
