"""Box geometry as Column expressions. A box is a struct or four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

least, greatest = F.least, F.greatest


class Box:
    """Four Columns, or names of some, with the usual figures. Names become Columns when they are used,
    so a box of names can be made before there is a session."""

    def __init__(self, x1, y1, x2, y2):
        self._sides = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}

    def __getattr__(self, name: str) -> Column:
        sides = self.__dict__.get("_sides", {})
        if name not in sides:
            raise AttributeError(name)
        return F.col(sides[name]) if isinstance(sides[name], str) else sides[name]

    @classmethod
    def of(cls, struct: Column) -> Box:
        return cls(struct["x1"], struct["y1"], struct["x2"], struct["y2"])

    @property
    def width(self):
        return self.x2 - self.x1

    @property
    def height(self):
        return self.y2 - self.y1

    @property
    def area(self):
        return greatest(F.lit(0), self.width * self.height)

    @property
    def cx(self):
        return (self.x1 + self.x2) / 2

    @property
    def cy(self):
        return (self.y1 + self.y2) / 2

    def struct(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))


def intersection(a: Box, b: Box) -> Column:
    """The area in common; 0 for boxes that only touch."""
    return greatest(F.lit(0), least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(F.lit(0), least(a.y2, b.y2) - greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (a.area + b.area - inter))


def small_ratio(a: Box, b: Box) -> Column:
    """The intersection's share of the smaller box."""
    low = least(a.area, b.area)
    return F.when(low > 0, intersection(a, b) / low).otherwise(F.lit(0.0))


def touch(a: Box, b: Box, pad: int = 2) -> Column:
    """Not parted by more than pad."""
    return ~((a.x2 + pad < b.x1) | (b.x2 + pad < a.x1) | (a.y2 + pad < b.y1) | (b.y2 + pad < a.y1))


def horizontal_neighbors(a: Box, b: Box, y_tolerance: float = 0.45) -> Column:
    """Two characters of one line: level, overlapping in height, a character (the wider one's width) apart,
    little in common. Boxes without area are no characters."""
    height, low = greatest(F.lit(1.0), (a.height + b.height) / 2), least(a.height, b.height)
    shared = greatest(F.lit(0), least(a.y2, b.y2) - greatest(a.y1, b.y1))
    char = greatest(a.width, b.width, F.lit(1))
    gap = F.abs(a.cx - b.cx)
    level = (F.abs(a.cy - b.cy) <= y_tolerance * height) & (shared >= 0.5 * low)
    return level & (gap >= 0.55 * char) & (gap <= 2.2 * char) & (least(a.area, b.area) > 0) & (small_ratio(a, b) < 0.35)


def x_overlap(a: Box, b: Box) -> Column:
    """The common width's share of the smaller width."""
    low = least(a.width, b.width)
    return F.when(low > 0, greatest(F.lit(0), least(a.x2, b.x2) - greatest(a.x1, b.x1)) / low).otherwise(F.lit(0.0))


def inside(x, y, box: Box, pad=0) -> Column:
    return (x >= box.x1 - pad) & (x <= box.x2 + pad) & (y >= box.y1 - pad) & (y <= box.y2 + pad)


def to_pixels(box: Box, width, height, norm: int = 1000) -> Box:
    """Coordinates of 0 to norm as pixels, half-even; as they are if any is larger or the page is small."""
    width, height = F.lit(width), F.lit(height)
    scale = (greatest(box.x1, box.y1, box.x2, box.y2) <= norm + 1) & (greatest(width, height) > norm)
    at = lambda v, side: F.when(scale, F.bround(v * side / norm)).otherwise(v).cast("int")
    xs, ys = (at(box.x1, width), at(box.x2, width)), (at(box.y1, height), at(box.y2, height))
    clamp = lambda v, most: greatest(F.lit(0), least(v, most))
    return Box(clamp(least(*xs), width - 1), clamp(least(*ys), height - 1), clamp(greatest(*xs), width), clamp(greatest(*ys), height))


def expand(box: Box, width, height, ratio: float = 0.15, y1_floor=None) -> Box:
    """Margins of ratio of each side, cut to whole pixels and to the page."""
    dx, dy = (box.width * ratio).cast("int"), (box.height * ratio).cast("int")
    y1 = greatest(F.lit(0), box.y1 - dy)
    if y1_floor is not None:
        y1 = greatest(y1, F.lit(y1_floor))
    return Box(greatest(F.lit(0), box.x1 - dx), y1, least(F.lit(width), box.x2 + dx), least(F.lit(height), box.y2 + dy))


def clip(box: Box, width, height) -> Box:
    """Within the page, at least one pixel each way."""
    x1, y1 = greatest(F.lit(0), least(box.x1, F.lit(width) - 1)), greatest(F.lit(0), least(box.y1, F.lit(height) - 1))
    return Box(x1, y1, greatest(x1 + 1, least(box.x2, F.lit(width))), greatest(y1 + 1, least(box.y2, F.lit(height))))


def page_scale(width, height, most: int = 2048):
    """(width, height, scale) of a page whose longer side is at most `most`."""
    longest = greatest(width, height)
    scale = F.when(longest <= most, F.lit(1.0)).otherwise(most / longest)
    return greatest(F.lit(1), (width * scale).cast("int")), greatest(F.lit(1), (height * scale).cast("int")), scale


def quad_box(quad: Column) -> Box:
    """The box of an array of (x, y) points, in whole pixels."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return Box(*(f(v).cast("int") for f, v in ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys))))


def rotate_back(box: Box, angle: float, rot_w, rot_h, width, height) -> Box:
    """A box seen on a page turned by angle, on the page itself: corners turned back, boxed, clamped."""
    import math

    cos, sin = math.cos(math.radians(-angle)), math.sin(math.radians(-angle))
    xs, ys = [], []
    for x, y in ((box.x1, box.y1), (box.x2, box.y1), (box.x2, box.y2), (box.x1, box.y2)):
        dx, dy = x - F.lit(rot_w) / 2, y - F.lit(rot_h) / 2
        xs.append(dx * cos + dy * sin + F.lit(width) / 2)
        ys.append(-dx * sin + dy * cos + F.lit(height) / 2)
    return clip(Box(least(*xs).cast("int"), least(*ys).cast("int"), greatest(*xs).cast("int"), greatest(*ys).cast("int")), width, height)
