"""Ink on page images, in numpy within Arrow batches, one page at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship


#: Weights of red, green and blue in a gray value, of 65,536.
LUMA = (19595, 38470, 7471)


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR bytes as gray values."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    return (a[..., 0] if channels == 1 else (a[..., 2] * LUMA[0] + a[..., 1] * LUMA[1] + a[..., 0] * LUMA[2] + 32768) >> 16).astype(np.uint8)


def _mean(a: np.ndarray, size: int) -> np.ndarray:
    """The Gaussian mean of a square about each pixel, edges repeated; the deviation follows the size."""
    r, sigma = size // 2, 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - r) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(a.astype(np.float64), r, mode="edge")
    rows = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + a.shape[1]] for i, w in enumerate(k))


def shifted(a: np.ndarray, pick, h: int, w: int) -> np.ndarray:
    """pick (minimum: erosion, maximum: dilation) over an h x w block from each pixel on."""
    out = a.copy()
    for dy in range(h):
        for dx in range(w):
            if dy or dx:
                b = np.zeros_like(a) if pick is np.maximum else np.ones_like(a)
                b[: a.shape[0] - dy or None, : a.shape[1] - dx or None] = a[dy:, dx:]
                out = pick(out, b)
    return out


def ink(page: np.ndarray, size: int = 31, offset: float = 11) -> np.ndarray:
    """Pixels darker than their surroundings, single ones dropped."""
    dark = (page <= np.rint(_mean(page, size)) - offset).astype(np.uint8)
    small = shifted(dark, np.minimum, 2, 2)
    back = np.zeros_like(small)
    for dy in (0, 1):
        for dx in (0, 1):
            back[dy:, dx:] |= small[: small.shape[0] - dy, : small.shape[1] - dx]
    return back.astype(bool)


def runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Pixels in horizontal runs of at least so many."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out = np.zeros_like(mask)
    for y, x, end in zip(*np.nonzero(edge == 1), np.nonzero(edge == -1)[1], strict=True):
        if end - x >= least:
            out[y, x:end] = True
    return out


def without_lines(mask: np.ndarray, box_side: int | None = None) -> np.ndarray:
    """Ink without straight lines of a twelfth of the page's side (or of box_side), 18 to 72 pixels."""
    wide, high = (int(np.clip(box_side or side // 12, 18, 72)) for side in (mask.shape[1], mask.shape[0]))
    return mask & ~runs(mask, wide) & ~runs(mask.T, high).T


def thinned(mask: np.ndarray) -> np.ndarray:
    """A morphological skeleton: what opening by a cross takes away, erosion after erosion until nothing is left."""
    def cross(a, pick):
        p = np.pad(a, 1)
        return pick.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    out, now = np.zeros_like(mask), mask.copy()
    while now.any():
        small = cross(now, np.logical_and)
        out |= now & ~cross(small, np.logical_or)
        now = small
    return out


def overlap_stats(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Ink in common, and its share of the smaller ink."""
    both, low = int((a & b).sum()), min(int(a.sum()), int(b.sum()))
    return both, both / low if low else 0.0


def is_fused(sk: Column, junc_ps: Column, edge: Column, ips: Column, junc_thr: float, edge_thr: float, ips_max: float) -> Column:
    """Whether ink metrics tell of glyphs run together: enough skeleton and all three thresholds met; the
    defaults of metrics that are null are those of a crop without ink."""
    sk, junc_ps, edge = (F.coalesce(c, F.lit(0.0)) for c in (sk, junc_ps, edge))
    return (sk >= 55) & (junc_ps >= junc_thr) & (edge >= edge_thr) & (F.coalesce(ips, F.lit(99.0)) <= ips_max)


def edges(page: np.ndarray, low: int = 40, high: int = 120) -> np.ndarray:
    """Canny edges of gray values: ridges of the gradient over high, and those over low that touch them."""
    p = np.pad(page.astype(np.int64), 1, mode="edge")
    side = p[:, 2:] - p[:, :-2]
    down = p[2:] - p[:-2]
    dx, dy = side[:-2] + 2 * side[1:-1] + side[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    ax, ay = np.abs(dx), np.abs(dy)
    m = np.pad(ax + ay, 1)
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    now, tan = at(0, 0), 13573 / 32768  # of an eighth of a right angle's half
    level, steep = ay < ax * tan, ay > ax * (tan + 2)
    rising = (dx < 0) != (dy < 0)
    across = (now > at(0, -1)) & (now >= at(0, 1))
    along = (now > at(-1, 0)) & (now >= at(1, 0))
    slant = np.where(rising, (now > at(-1, 1)) & (now > at(1, -1)), (now > at(-1, -1)) & (now > at(1, 1)))
    ridge = (now > low) & np.where(level, across, np.where(steep, along, slant))
    return grown(ridge & (now > high), ridge)


def grown(seed: np.ndarray, within: np.ndarray) -> np.ndarray:
    """What of `within` the seed reaches, step by step to any of the eight neighbours."""
    now = seed & within
    while True:
        more = _near(now) & within
        if (more == now).all():
            return now
        now = more


def _near(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Pixels of a mask and their eight neighbours."""
    for _ in range(rounds):
        p = np.pad(mask, 1)
        wide = p[:, :-2] | p[:, 1:-1] | p[:, 2:]
        mask = wide[:-2] | wide[1:-1] | wide[2:]
    return mask


#: What a crop has that holds under LEAST_INK pixels of ink.
LEAST_INK = 12
NO_INK = {"junc_ps": 0.0, "edge": 0.0, "ips": 99.0, "sk": 0.0, "ink": 0.0}


def fused_metrics(page: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int] | None = None) -> dict[str, float]:
    """Of the ink (mask, without long lines) in a box of a page, cut to the ink: its pixels and its skeleton's, junctions
    for each pixel of skeleton, ink for each, and the share of edge pixels."""
    h, w = mask.shape
    x1, y1, x2, y2 = box or (0, 0, w, h)
    x1, y1 = max(0, min(x1, w - 1)), max(0, min(y1, h - 1))
    window = np.s_[y1 : max(y1 + 1, min(y2, h)), x1 : max(x1 + 1, min(x2, w))]
    crop, seen = mask[window], page[window]
    ys, xs = np.nonzero(crop)
    if len(xs) < LEAST_INK:
        return dict(NO_INK)
    tight = np.s_[max(0, ys.min() - 1) : ys.max() + 2, max(0, xs.min() - 1) : xs.max() + 2]
    crop, seen = crop[tight], seen[tight]
    bones = thinned(crop)
    p = np.pad(bones, 1, mode="reflect" if min(bones.shape) > 1 else "edge").astype(np.int64)
    beside = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    n, sk = int(crop.sum()), int(bones.sum())
    return {"junc_ps": float((bones & (beside >= 3)).sum()) / max(sk, 1), "edge": float(edges(seen).mean()), "ips": n / max(sk, 1), "sk": float(sk), "ink": float(n)}


#: Fixed values of group_overlap.
SMALLEST_CROP, SMALLEST_INK, LEAST_PART, LEAST_SHARE, MOST_PARTS, ERODED = 30, 40, 20, 0.03, 4, (1, 2)


def group_overlap(mask: np.ndarray, min_pixels: float, min_ratio: float) -> dict[str, float] | None:
    """Whether the ink of a box's crop is two groups run into each other: eroded until it falls apart, its largest parts
    are grown back by a pixel more; of the pairs that then share ink enough, the one with the most. None: no such pair."""
    if mask.size < SMALLEST_CROP or mask.sum() < SMALLEST_INK:
        return None
    least = max(LEAST_PART, int(LEAST_SHARE * mask.sum()))
    small = mask
    for rounds in ERODED:
        small = _eroded(small)
        found = sorted((c for c in parts(small) if c.sum() >= least), key=lambda c: -int(c.sum()))[:MOST_PARTS]
        back = [_near(c, rounds + 1) & mask for c in found]
        best = None
        for i, a in enumerate(back):
            for b in back[i + 1 :]:
                inter, ratio = overlap_stats(a, b)
                if inter >= min_pixels and ratio >= min_ratio and (best is None or inter > best["ink_inter"]):
                    best = {"ink_inter": float(inter), "ink_a": float(a.sum()), "ink_b": float(b.sum()), "ink_ratio": ratio}
        if best:
            return best
    return None


def _eroded(mask: np.ndarray) -> np.ndarray:
    """Pixels that stand with those above, to the left, and above to the left; beyond the edge counts as ink."""
    p = np.pad(mask, ((1, 0), (1, 0)), constant_values=True)
    return p[1:, 1:] & p[:-1, 1:] & p[1:, :-1] & p[:-1, :-1]


def parts(mask: np.ndarray) -> list[np.ndarray]:
    """The connected parts, by any of eight neighbours, in reading order of their first pixels."""
    left, out = mask.copy(), []
    while left.any():
        seed = np.zeros_like(left)
        seed.flat[int(left.argmax())] = True
        one = grown(seed, left)
        out.append(one)
        left &= ~one
    return out


def ink_pairs(boxes: DataFrame, inked: Callable[[Column, Column], Column]) -> DataFrame:
    """(drawing_id, a, b, inter, ratio) of the boxes (drawing_id, iid, x1 to y2; x2 and y2 outside) of a page
    that have ink in common: overlap_stats of all pairs, for ink given by a condition on x and y. Boxes read
    the same page, so the ink in common is the ink of the rectangle in common, whatever the boxes' size."""

    def ink_of(x1, y1, x2, y2):
        ys = F.sequence(y1, y2 - 1)
        column = lambda x: F.size(F.filter(ys, lambda y: inked(x, y))).cast("long")
        return F.when((x2 > x1) & (y2 > y1), F.aggregate(F.sequence(x1, x2 - 1), F.lit(0).cast("long"), lambda n, x: n + column(x))).otherwise(F.lit(0).cast("long"))

    rows = boxes.select("drawing_id", "iid", "x1", "y1", "x2", "y2").withColumn("ink", ink_of(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    a, b = (rows.select("drawing_id", *[F.col(c).alias(f"{side}_{c}") for c in ("iid", "x1", "y1", "x2", "y2", "ink")]) for side in "ab")
    meet = (F.col("a_iid") < F.col("b_iid")) & (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2"))
    met = a.join(b, "drawing_id").filter(meet)
    met = met.withColumn("inter", ink_of(F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1"), F.least("a_x2", "b_x2"), F.least("a_y2", "b_y2"))).filter("inter > 0")
    return met.select("drawing_id", F.col("a_iid").alias("a"), F.col("b_iid").alias("b"), "inter", (F.col("inter") / F.least("a_ink", "b_ink")).alias("ratio"))


def box_ink(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(drawing_id, iid, ink, sk, junc_ps, edge, ips) of boxes on pages: a page's ink is found once, boxes read crops.
    is_fused() decides on them."""
    ship(pages.sparkSession)
    names = ["ink", "sk", "junc_ps", "edge", "ips"]

    def run(key, page: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(page):
            p = page.iloc[0]
            page_ = gray(p["data"], p["height"], p["width"], p["channels"])
            mask = without_lines(ink(page_))
            for r in rows.itertuples():
                found = fused_metrics(page_, mask, (r.x1, r.y1, r.x2, r.y2))
                out.append((r.drawing_id, r.iid, *(found[n] for n in names)))
        return pd.DataFrame(out, columns=["drawing_id", "iid", *names])

    return pages.groupBy("drawing_id").cogroup(boxes.groupBy("drawing_id")).applyInPandas(run, f"drawing_id {boxes.schema['drawing_id'].dataType.simpleString()}, iid long, " + ", ".join(f"{n} double" for n in names))
