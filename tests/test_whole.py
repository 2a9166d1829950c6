"""The drawing queries that take all boxes, by brute force."""

from collections import Counter, defaultdict

import numpy as np
from draftlens import model
from draftlens import queries as q
from draftlens.operators import pixels
from draftlens.plans import rules as rl

SF = "/root/testdata/sf0.001"


def test_ink_of_all_pairs_at_full_size(spark):
    y, x = np.mgrid[:1500, :2000]
    page = (x * 7 + y * 3) % 5 != 0
    boxes = defaultdict(list)
    for r in q.inst(spark, SF).collect():
        boxes[r.drawing_id].append(r)
    want = {}
    for rows in boxes.values():
        for a in rows:
            for b in rows:
                if a.iid < b.iid and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2:
                    masks = []
                    for r in (a, b):
                        masks.append(np.zeros_like(page))
                        masks[-1][r.y1 : r.y2, r.x1 : r.x2] = page[r.y1 : r.y2, r.x1 : r.x2]
                    both, ratio = pixels.overlap_stats(*masks)
                    if both:
                        want[a.drawing_id, a.iid, b.iid] = (both, ratio)
    got = {(r.drawing_id, r.a, r.b): (r.inter, r.ratio) for r in q.QUERIES["ink_overlap_stats"](spark, SF).collect()}
    assert got == want and max(v[0] for v in want.values()) > 144


def test_ink_of_boxes_without_area_or_on_edges(spark):
    rows = [(1, 1, 0, 0, 30, 40), (1, 2, 30, 0, 60, 40), (1, 3, 29, 39, 90, 90), (1, 4, 5, 5, 5, 9), (2, 5, 0, 0, 30, 40)]
    df = spark.createDataFrame(rows, "drawing_id long, iid long, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in pixels.ink_pairs(df, lambda x, y: x >= 0).orderBy("a").collect()] == [(1, 1, 3, 1, 1 / 1200), (1, 2, 3, 30, 30 / 1200)]


def test_all_boxes_and_findings_are_drawn(spark):
    drawn = q.QUERIES["draw_list"](spark, SF).collect()
    n = Counter(r.kind for r in drawn)
    assert n["overlap"] + n["attribute"] == q.inst(spark, SF).count() and n["overlap"] and n["attribute"]
    found = rl.findings(model.facts(spark, SF), q.RULES).collect()
    assert n["finding"] == sum(r.evidence_bboxes.count("x1") for r in found) > 0


def test_thick_ink_is_thinned_to_its_middle():
    mask = np.zeros((211, 211), bool)
    mask[5:206, 5:206] = True
    assert pixels.thinned(mask)[105, 105]


def test_fused_needs_all_thresholds(spark):
    rows = [(55.0, 0.1, 0.2, 3.0), (54.0, 0.1, 0.2, 3.0), (55.0, 0.05, 0.2, 3.0), (55.0, 0.1, 0.1, 3.0), (55.0, 0.1, 0.2, 3.1), (55.0, 0.1, 0.2, None)]
    df = spark.createDataFrame(rows, "sk double, junc_ps double, edge double, ips double")
    got = df.select("*", pixels.is_fused(df.sk, df.junc_ps, df.edge, df.ips, 0.1, 0.2, 3.0).alias("fused")).collect()
    assert [r.fused for r in got] == [True, False, False, False, False, False]


def test_edges_are_the_outline():
    page = np.full((40, 40), 220, np.uint8)
    page[10:30, 12:28] = 30
    got = pixels.edges(page)
    ys, xs = np.nonzero(got)
    assert ys.min() in (9, 10) and ys.max() in (29, 30) and xs.min() in (11, 12) and xs.max() in (27, 28)
    assert not got[14:26, 16:24].any() and not pixels.edges(np.full((20, 20), 99, np.uint8)).any()
    faint = np.full((20, 40), 200, np.uint8)
    faint[:, 20:] = 185  # gradient 60: over the low bound only
    assert not pixels.edges(faint).any()
    faint[:4, 20:] = 20
    assert pixels.edges(faint)[10:, 18:22].any()


def test_ink_is_darker_than_the_gaussian_mean():
    page = np.full((80, 80), 200, np.uint8)
    page[40:44, 20:60] = 60
    mask = pixels.ink(page)
    assert mask[40:44, 22:58].all() and mask.sum() == 160
    k = np.exp(-((np.arange(31) - 15) ** 2) / 50)
    p = np.pad(page.astype(float), 15, mode="edge")
    want = (p[38 : 38 + 31, 30 : 30 + 31] * np.outer(k, k)).sum() / k.sum() ** 2
    assert abs(pixels._mean(page, 31)[38, 30] - want) < 1e-9
    assert pixels.gray(bytes([10, 20, 30] * 2), 1, 2, 3).tolist() == [[22, 22]]


def test_fused_metrics_of_a_cross():
    page = np.full((80, 80), 230, np.uint8)
    mask = np.zeros((80, 80), bool)
    mask[30:50, 39:41] = mask[39:41, 30:50] = True
    page[mask] = 20
    got = pixels.fused_metrics(page, mask, (20, 20, 60, 60))
    assert got["ink"] == mask.sum() and got["junc_ps"] == 1.0 and got["edge"] == 40 / 22**2 and got["ips"] == got["ink"] / got["sk"]
    assert pixels.fused_metrics(page, mask, (0, 0, 10, 10)) == pixels.NO_INK


def test_groups_in_a_box():
    mask = np.zeros((30, 60), bool)
    mask[5:25, 5:25] = mask[5:25, 27:47] = True
    mask[14:16, 25:27] = True  # a thin bridge
    got = pixels.group_overlap(mask, 1, 0.0)
    assert got and got["ink_inter"] >= 1 and len(pixels.parts(mask)) == 1 and len(pixels.parts(pixels._eroded(pixels._eroded(mask)))) == 2
    assert pixels.group_overlap(mask[:, :24], 1, 0.0) is None and pixels.group_overlap(mask, 1000, 0.0) is None


def test_box_ink(spark):
    page = np.full((60, 60, 3), 230, np.uint8)
    page[20:32, 20:24] = 10
    pages = spark.createDataFrame([(1, bytearray(page.tobytes()), 60, 60, 3)], "drawing_id long, data binary, height int, width int, channels int")
    boxes = spark.createDataFrame([(1, 7, 10, 10, 50, 50), (1, 8, 0, 0, 5, 5), (2, 9, 0, 0, 5, 5)], "drawing_id long, iid long, x1 int, y1 int, x2 int, y2 int")
    got = {r.iid: r for r in pixels.box_ink(pages, boxes).collect()}
    assert got[7].ink == 48 and got[7].sk > 0 and got[8].ink == 0 and got[8].ips == 99 and 9 not in got
