"""Golden cases of the drawing engine."""

import numpy as np
import pytest
from draftlens.functions import angle as an
from draftlens.functions import geometry as g
from draftlens.functions import text as tx
from draftlens.operators import fuzzy, greedy, pixels, plans
from draftlens.plans import rules as rl
from draftlens.sources import files
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
FACTS = f"drawing_id string, title_block struct<part_no:string,ref:string,n:int,bbox:{BOX}>, components array<struct<id:string,value:string,bbox:{BOX}>>, tables array<struct<id:string>>, annotations array<struct<id:string,keep_pair:boolean,bbox:{BOX}>>"


@pytest.fixture(scope="module")
def facts(spark):
    box = lambda *x: tuple(float(v) for v in x)
    return spark.createDataFrame([
        ("a", ("A-1", "R1", 3, box(10, 10, 50, 40)), [("R1", "10k", box(0, 0, 5, 5)), ("R2", "20k", None)], [("T9",)], [("m", True, box(0, 0, 10, 10)), ("n", True, box(9, 9, 20, 20)), ("o", True, box(20, 20, 30, 30))]),
        ("b", (None, "T9", 0, box(10, 10, 50, 40)), [], [("T9",)], [("m", True, box(0, 0, 10, 10)), ("n", False, box(9, 9, 20, 20))]),
        ("c", ("  ", None, None, None), None, None, None),
    ], FACTS)


def ok(facts, logic):
    x = rl.compile_logic(logic, facts.schema)
    return [r.ok for r in facts.select(x.ok.alias("ok")).collect()]


CASES = [
    ({"op": "not_empty", "path": "title_block.part_no"}, [True, False, False]),
    ({"op": "not_empty", "path": "title_block.n"}, [True, True, False]),
    ({"op": "not_empty", "path": "title_block.nothing"}, [False, False, False]),
    ({"op": "eq", "path": "title_block.n", "value": True}, [False, False, False]),
    ({"op": "eq", "path": "title_block.n", "value": 3.0}, [True, False, False]),
    ({"op": "eq", "path": "title_block.n", "value": "3"}, [False, False, False]),
    ({"op": "eq", "path": "components.value", "value": ["10k", "20k"]}, [True, False, False]),
    ({"op": "eq", "path": "title_block.part_no", "value": None}, [False, True, False]),
    ({"op": "neq", "path": "title_block.part_no", "value": "A-1"}, [False, True, True]),
    ({"op": "in", "path": "title_block.part_no", "value": ["x", None]}, [False, True, False]),
    ({"op": "regex", "path": "title_block.part_no", "pattern": r"\d"}, [True, False, False]),
    ({"op": "count_gte", "path": "components", "count": 2}, [True, False, False]),
    ({"op": "count_gte", "path": "title_block.part_no", "count": 3}, [True, False, False]),
    ({"op": "count_gte", "path": "title_block.n", "count": 1}, [False, False, False]),
    ({"op": "count_lte", "path": "components", "count": 0}, [False, True, True]),
    ({"op": "ref_exists", "path": "title_block.ref"}, [True, False, False]),
    ({"op": "bbox_overlap_count_lte", "path": "annotations", "count": 0}, [False, False, True]),
    ({"op": "bbox_overlap_count_lte", "path": "annotations", "count": 0, "only_keep_pair": True}, [False, True, True]),
    ({"op": "and", "args": []}, [True, True, True]),
    ({"op": "or", "args": []}, [False, False, False]),
    ({"op": "not", "arg": {"op": "not_empty", "path": "components[1].id"}}, [False, True, True]),
]


@pytest.mark.parametrize("logic,want", CASES)
def test_operators(facts, logic, want):
    assert ok(facts, logic) == want


def test_paths_and_payloads(facts):
    x = rl.compile_logic({"op": "and", "args": [{"op": "not_empty", "path": "components.id.rest"}, {"op": "eq", "path": "title_block.n", "value": 1}]}, facts.schema)
    rows = facts.select(x.actual.alias("a"), x.expected.alias("e")).collect()
    assert tuple(rows[0]) == ("3", "1") and tuple(rows[1]) == ("[]", "非空")
    o = rl.compile_logic({"op": "bbox_overlap_count_lte", "path": "annotations", "count": 0}, facts.schema)
    assert facts.select(o.actual, o.ids).first()[:] == ("1", ["m", "n"])


def test_errors(facts):
    for bad in ({"op": "xor"}, {"op": "eq"}, {"op": "in", "path": "a", "value": 3}, {"op": "regex", "path": "a"}, {"op": "count_gte", "path": "a"}, {"op": "not"}):
        with pytest.raises(rl.RuleError):
            rl.compile_logic(bad, facts.schema)
    assert rl.validate({"rule_id": "R", "name": "n", "severity": "error", "logic": {"op": "and", "args": [{"op": "eq", "path": "a"}]}}) == ["logic.args[0]: value is missing"]


def test_findings_and_results(facts):
    rule = {"rule_id": "R", "severity": "error", "message": "m", "logic": {"op": "not_empty", "path": "title_block.part_no"}}
    rows = {r.drawing_id: r for r in rl.findings(facts, [rule, rule | {"status": "draft"}]).collect()}
    assert set(rows) == {"b", "c"} and rows["b"].evidence_bboxes == '[{"x1":10.0,"y1":10.0,"x2":50.0,"y2":40.0}]'
    assert {r.drawing_id: r.passed for r in rl.results(facts, [rule]).collect()} == {"a": True, "b": False, "c": False}
    assert {r.passed for r in rl.results(facts, [rule | {"severity": "warn"}]).collect()} == {True}
    assert rl.findings(facts, []).count() == 0


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


DIMENSIONS = {
    "Ø12±0.1": ("diameter", "12", "0.1", True), "R5": ("radius", "5", None, False), "R10+/-0.2": ("radius", "10", "0.2", True), "25.5": ("length", "25.5", None, False),
    "30°": ("angle", "30", None, False), "45°±1": ("angle", "45", "1", True), "": (None, None, None, False), "abc": (None, None, None, False),
    "12,5": ("length", "12.5", None, False), "M8": ("length", "8", None, False), "R5±": ("radius", "5", None, True),
}


def test_dimensions(spark):
    df = spark.createDataFrame([(k,) for k in DIMENSIONS], "t string")
    got = {r.t: tuple(r.p) for r in df.select("t", tx.parse_dimension(F.col("t")).alias("p")).collect()}
    assert got == DIMENSIONS


def test_number_marks(spark):
    want = {"12±0.1": True, "R5": True, "25001745002A": False, "25001743T.2": False, "Siemens 2025": False, "sheet 3": False, "": False}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.p for r in df.select("t", tx.number_mark(F.col("t")).alias("p")).collect()} == want


def test_angles(spark):
    a = lambda x: an.normalize(F.lit(float(x)))
    assert one(spark, a(135), a(-135), a(90), a(-90), a(0))[:] == (-45.0, 45.0, 90.0, 90.0, 0.0)
    b = lambda *x: an.from_box(g.Box(*[F.lit(v) for v in x]))
    assert one(spark, b(10, 10, 20, 80), b(10, 10, 80, 20))[:] == (90.0, 0.0)
    rows = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([45, 44, 46, 0, 90])], "drawing_id string, iid int, angle double")
    assert [r.angle for r in greedy.extra_angles(rows).collect()] == [-45]


def test_geometry(spark):
    lit = lambda *x: g.Box(*[F.lit(v) for v in x])
    assert one(spark, g.iou(lit(0, 0, 4, 4), lit(0, 0, 4, 4)), g.iou(lit(0, 0, 1, 1), lit(5, 5, 6, 6)), g.intersection(lit(0, 0, 10, 10), lit(10, 0, 20, 10)))[:] == (1.0, 0.0, 0)
    p, q = g.to_pixels(lit(500, 500, 600, 600), 2000, 1400), g.to_pixels(lit(500, 500, 600, 600), 800, 600)
    assert one(spark, p.x1, p.y1, p.x2, p.y2)[:] == (1000, 700, 1200, 840)
    assert one(spark, q.x1, q.y1, q.x2, q.y2)[:] == (500, 500, 600, 600)


def test_tiles_twins_nms(spark):
    t = plans.tiles(spark.createDataFrame([(3000, 2000)], "width int, height int")).orderBy("y1", "x1").collect()
    assert [(r.x1, r.x2) for r in t[:3]] == [(0, 1280), (1024, 2304), (2048, 3000)] and len(t) == 6 and {(r.y1, r.y2) for r in t} == {(0, 1280), (1024, 2000)}
    boxes = spark.createDataFrame([("d", 1, 0, 0, 100, 20), ("d", 2, 0, 0, 50, 50)], "drawing_id string, iid int, x1 int, y1 int, x2 int, y2 int")
    got = {r.parent_id: (r.x1, r.y1, r.x2, r.y2) for r in plans.twins(boxes).collect()}
    assert got == {"1": (0, 0, 72, 20), "1_twin": (28, 0, 100, 20), "2": (0, 0, 50, 36), "2_twin": (0, 14, 50, 50)}
    rows = spark.createDataFrame([("d", "e", 1, 0, 0, 10, 10, 9), ("d", "e", 2, 1, 0, 11, 10, 8), ("d", "e", 3, 50, 50, 60, 60, 7)], "drawing_id string, entity_id string, iid int, x1 int, y1 int, x2 int, y2 int, conf int")
    assert sorted(r.iid for r in greedy.nms(rows).collect()) == [1, 3]


def test_json_and_labels():
    assert fuzzy.salvage('[{"a": 1}, {"a": 2}, {"a"') == '[{"a": 1}, {"a": 2}]' and fuzzy.salvage("not json") is None and fuzzy.salvage("[1]") == "[1]"
    assert fuzzy.label_score("weight", "weight") == 1.0 and fuzzy.label_score("weight kg", "weight") == 0.9 and fuzzy.label_score("veight", "weight") == 0.82 and fuzzy.label_score("x", "weight") == 0.0


def test_ink():
    page = np.full((80, 80), 255.0)
    page[20:26, 10:60] = 0
    page[40:60, 30:34] = 0
    mask = pixels.ink(page)
    assert mask[22, 30] and mask[50, 31] and not mask[5, 5]
    assert pixels.overlap_stats(mask, mask) == (int(mask.sum()), 1.0) and pixels.overlap_stats(mask, ~mask)[0] == 0
    assert 0 < pixels.thinned(mask).sum() < mask.sum() and not pixels.without_lines(mask, 18)[22, 30]


def test_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"rule_id": "B", "status": "active"}')
    (tmp_path / "a.json").write_text('{"rule_id": "A", "status": "draft"}')
    assert [r["rule_id"] for r in files.load_rules(spark, str(tmp_path))] == ["B"] and [r["rule_id"] for r in files.load_rules(spark, str(tmp_path), False)] == ["A", "B"]
    assert files.load_rules(spark, str(tmp_path / "none")) == []
    assert files.options({"drawing": "x"}, {"rule_ids": "R", "drawing": "y"}, {"n": 1}) == {"drawing": "x", "rule_ids": ["R"], "n": 1}
    with pytest.raises(ValueError):
        files.options({}, {}, {"n": 1})


def test_streamed_findings_equal_batch(spark, facts, tmp_path):
    from draftlens.streaming import review

    rule = {"rule_id": "R", "logic": {"op": "not_empty", "path": "title_block.part_no"}}
    facts.write.parquet(str(tmp_path / "in"))
    found = review.findings_stream(review.facts_stream(spark, str(tmp_path / "in"), facts.schema), [rule])
    review.into_log(found, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.drawing_id for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {"b", "c"}


def box(*x):
    return g.Box(*[F.lit(v) for v in x])


def test_neighbours_by_the_wider_character(spark):
    """Centres are 26 apart: over .55 of the mean width, under .55 of the wider one's."""
    assert one(spark, g.horizontal_neighbors(box(0, 0, 60, 20), box(46, 0, 66, 20)), g.horizontal_neighbors(box(0, 0, 20, 20), box(18, 0, 38, 20)), g.horizontal_neighbors(box(0, 0, 0, 20), box(3, 0, 23, 20)))[:] == (False, True, False)


def boundary_of(spark, material, main, **more):
    df = spark.createDataFrame([("d", *material, *main)], "drawing_id string, " + ", ".join(f"{p}_{c} int" for p in "mn" for c in ("x1", "y1", "x2", "y2")))
    r = plans.boundary(df, 1000, **more).first()
    return (r.m_y1, r.m_y2), (r.n_y1, r.n_y2), r.y1_floor


def test_material_main_boundary(spark):
    assert boundary_of(spark, (0, 100, 9, 350), (0, 200, 9, 420), min_main=100) == ((100, 198), (200, 420), 200)
    assert boundary_of(spark, (0, 100, 9, 200), (0, 210, 9, 400)) == ((100, 200), (210, 400), 202)
    assert boundary_of(spark, (0, 300, 9, 400), (0, 100, 9, 200)) == ((100, 200), (300, 400), 202)
    assert boundary_of(spark, (0, 105, 9, 150), (0, 100, 9, 400)) == ((105, 113), (115, 400), 115)  # five pixels lower is no swap


def test_twins_of_odd_widths(spark):
    rows = spark.createDataFrame([("d", 1, 0, 0, 101, 20), ("d", 2, 5, 5, 5, 5)], "drawing_id string, iid int, x1 int, y1 int, x2 int, y2 int")
    got = {r.parent_id: (r.x1, r.y1, r.x2, r.y2) for r in plans.twins(rows).collect()}
    assert got["1"] == (0, 0, 72, 20) and got["1_twin"] == (28, 0, 101, 20) and got["2"] == (5, 5, 5, 7) and got["2_twin"] == (5, 5, 5, 5)


@pytest.mark.parametrize(
    ("kept", "other", "same"),
    [
        ((0, 0, 100, 20, 0), (40, -40, 50, 60, 0), False),  # tall across a lower, wide one
        ((0, 0, 100, 100, 0), (45, 45, 55, 55, 0), False),  # small and inside
        ((0, 0, 100, 100, 0), (20, 20, 85, 85, 0), True),  # inside, by its area
        ((0, 0, 10, 10, 0), (11, 0, 21, 10, 0), False),  # a side apart
        ((0, 0, 30, 10, 0), (0, 12, 30, 22, 0), True),  # 12 apart, .45 of 30 is 13.5
        ((0, 0, 10, 30, 90), (11, 0, 21, 30, 85), True),
        ((0, 0, 10, 30, 90), (32, 0, 42, 30, -85), True),  # 32 apart, both turned: 1.1 of 30 is 33
        ((0, 0, 10, 30, 90), (32, 0, 42, 30, 0), False),
    ],
)
def test_near_duplicates(spark, kept, other, same):
    rows = [("d", 1, *kept[:4], 9, kept[4]), ("d", 2, *other[:4], 8, other[4])]
    df = spark.createDataFrame(rows, "drawing_id string, iid int, x1 int, y1 int, x2 int, y2 int, conf int, angle int")
    assert len(greedy.cluster(df).collect()) == (1 if same else 2)


LABELS = [
    ("finish surface treatment note", "surface finish", 0.8), ("mass", "calculated mass", 0.85), ("calculated mass kg", "calculated mass", 0.85), ("surfoce", "surface", 0.82),
    ("surface mm2", "surface", 0.9), ("additional material information", "material", 0.0), ("ma ss", "mass", 0.82), ("rev", "rew", 0.0), ("weight", "weight", 1.0), ("x", "drawing number", 0.0), ("", "mass", 0.0),
]


def test_label_scores(spark):
    for text, alias, score in LABELS:
        assert abs(fuzzy.label_score(text, alias) - score) < 1e-9, (text, alias)
    df = spark.createDataFrame([(t, [a, "zzzz"]) for t, a, _ in LABELS], "t string, a array<string>")
    assert [round(r.s, 9) for r in df.select(fuzzy.match_label(F.col("t"), F.col("a")).alias("s")).collect()] == [s for _, _, s in LABELS]


def test_hints_and_blanks(spark):
    assert one(spark, tx.after_hint(F.lit("QTY: 4 Qty: 5"), "Qty"), plans.field_match(F.lit("\t a\n"), F.lit("a")), plans.field_match(F.lit(None), F.lit("a")))[:] == ("5", True, False)


def test_extra_angles_add_to_the_standing_ones(spark):
    rows = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([45, 44, 46, 76, 75, 77, 30, 31])], "drawing_id string, iid int, angle double")
    assert [r.angle for r in greedy.extra_angles(rows).collect()] == [-45, -75, -30]
    assert [r.angle for r in greedy.extra_angles(rows, existing=(-45,)).collect()] == [-75, -30]


def test_boxes_without_parents_pair_by_iou(spark):
    rows = [("d", 1, 0, 0, 10, 10), ("d", 2, 9, 9, 19, 19), ("d", 3, 2, 0, 12, 10), ("d", 4, 100, 0, 110, 10), ("d", 5, 104, 0, 114, 10)]
    df = spark.createDataFrame(rows, "drawing_id string, iid long, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r.iid, r.x1, r.x2, r.n) for r in greedy.merge_by_iou(df).collect()) == [(1, 0, 12, 2), (2, 9, 19, 1), (4, 100, 114, 2)]


def test_overlaps_by_grid_equal_the_projection(spark):
    """Both ways give the same pairs, boxes and ids, with missing boxes, names and lists."""
    import random

    rng = random.Random(4)
    item = lambda k: {"bbox": None if k % 17 == 0 else dict(zip(("x1", "y1", "x2", "y2"), (lambda x, y: (x, y, x + rng.randint(0, 150), y + rng.randint(0, 60)))(rng.randint(-50, 400), rng.randint(0, 300)), strict=True)), "id": None if k % 5 == 0 else f"n{k}", "keep_pair": rng.choice([True, False, None]), "parent_id": rng.choice(["p", "q", None])}
    facts = spark.createDataFrame([(k, [item(j) for j in range(rng.randint(0, 25))] if k else None) for k in range(12)], "drawing_id int, annotations array<struct<bbox:struct<x1:int,y1:int,x2:int,y2:int>,id:string,keep_pair:boolean,parent_id:string>>")
    for more in ({}, {"min_box_side": 8, "only_keep_pair": True}, {"ignore_horizontal_neighbors": True, "min_overlap_ratio": 0.1}, {"iou_thr": 0.2}):
        logic = {"op": "bbox_overlap_count_lte", "path": "annotations", "count": 0, **more}
        direct = rl.compile_logic(logic, facts.schema)
        want = facts.select("drawing_id", direct.actual.alias("n"), direct.boxes.alias("b"), direct.ids.alias("i")).filter("n <> '0'").collect()
        rule = {"rule_id": "R", "name": "r", "severity": "error", "logic": {"op": "not", "arg": {"op": "not", "arg": logic}}}
        got = rl.findings(facts, [rule]).select("drawing_id", "actual", "evidence_bboxes", "related_ids").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_salvage_of_deep_nesting():
    assert fuzzy.salvage("[" * 100_000) is None and fuzzy.salvage('{"a": 1}' + "[" * 100_000) == '[{"a": 1}]'


def test_plan_of_a_configuration(spark):
    from draftlens.operators import planning

    config = {
        "objects": [
            {"entity_id": "stamp", "fields": [{"name": "who"}, {"name": ""}, "x"], "max_new_tokens": "64"}, {"entity_id": "off", "enabled": False}, {"locate_query": "no id"},
            {"parse_kind": "Dimension_Marks", "enabled": True, "backend": "OCR", "exclude_table_pad": 3},
        ],
        "tables": {"locate_query": "the table", "sections": [{"entity_id": "material_table", "read_mode": "above_cells", "fields": [{"name": "weight", "parse_hint": "Weight/Mass", "required": 1, "locate_by": "size_position"}]}, {"entity_id": "main_table", "enabled": False}]},
        "dimension_marks": {"enabled": True, "entity_id": "old"},
    }
    plan = planning.parse_plan(config)
    assert [e["entity_id"] for e in plan] == ["stamp", "number_mark", "material_table"]
    assert plan[0] == {"entity_id": "stamp", "locate_query": "stamp", "cardinality": "one", "parse_kind": "object", "fields": [{"name": "who", "parse_hint": "who", "required": False, "locate_by": "label"}], "crop_expand": None, "max_new_tokens": 64}
    assert plan[1]["backend"] == "ocr" and len(plan[1]["fields"]) == 6 and plan[1]["exclude_table_pad"] == 3.0 and plan[1]["ocr_angle_adapt_step"] == 15.0
    assert plan[2]["value_as_array"] and plan[2]["locate_query"] == "the table" and plan[2]["section"] == "material_table" and plan[2]["fields"][0]["locate_by"] == "size_position"
    assert planning.parse_plan({"dimension_marks": {"enabled": True}})[0]["entity_id"] == "number_mark" and planning.parse_plan(None) == [] and not planning.marks_config({})["enabled"]
    rows = planning.plan_rows(spark, plan)
    assert planning.merge_fields(rows.unionByName(rows.withColumn("seq", F.col("seq") + 9))).count() == 3


def test_fields_above_labels(spark):
    from draftlens.operators import planning

    items = [(1, "Weight", 0, 100, 50, 110), (2, " 12 kg ", 2, 80, 48, 90), (3, "11 kg", 2, 60, 48, 70), (4, "far", 0, 0, 50, -5), (5, "Surfoce mm2", 100, 100, 150, 110), (6, "Article number", 100, 90, 150, 96), (7, "8 mm", 100, 75, 150, 85), (8, "weight", 0, 20, 50, 30), (9, "", 0, 70, 50, 80)]
    rows = spark.createDataFrame([(1, i, t, *b) for i, t, *b in items], "table_id int, iid int, text string, x1 int, y1 int, x2 int, y2 int")
    fields = spark.createDataFrame([(1, 0, "weight"), (1, 1, "surface"), (1, 2, "volume")], "table_id int, seq int, name string").withColumn("aliases", tx.field_aliases(F.lit("重 量"), F.col("name")))
    got = {r.name: (r.label, r["values"]) for r in planning.fields_above_labels(rows, fields).collect()}
    # The lower of two equal labels; the article number is text like any other here, as no field has its alias.
    assert got == {"weight": ("Weight", ["11 kg", "12 kg"]), "surface": ("Surfoce mm2", ["8 mm", "Article number"]), "volume": (None, None)}


def test_review_decisions(spark):
    from draftlens.operators import planning, state

    items = spark.createDataFrame([("a", "pending"), ("b", "pending")], "drawing_id string, status string")
    done = state.resolve(items, spark.createDataFrame([("a", "revise", "me", None)], "drawing_id string, decision string, reviewer string, comment string"))
    assert {(r.drawing_id, r.status, r.decision, r.comment) for r in done.collect()} == {("a", "resolved", "revise", ""), ("b", "pending", None, None)}
    with pytest.raises(Exception, match="unknown decision"):
        state.resolve(items, spark.createDataFrame([("a", "maybe", "me", "")], "drawing_id string, decision string, reviewer string, comment string")).collect()
    cells = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, planning.as_list(cells(" a ", None, "", "b")), planning.as_list(cells(" ", None)), planning.as_scalar(cells("x ")), planning.as_scalar(cells("x", "y")), planning.as_scalar(F.lit(None).cast("array<string>")))[:] == (["a", "b"], None, "x", '["x","y"]', None)


def test_streamed_overlaps_and_windows(spark, tmp_path):
    """The overlap rule needs no state on a stream; late events count within the watermark."""
    from draftlens.streaming import review

    bbox = lambda x: {"x1": x, "y1": 0, "x2": x + 10, "y2": 10}
    facts = spark.createDataFrame([(1, [{"bbox": bbox(0), "id": "a"}, {"bbox": bbox(5), "id": "b"}]), (2, [{"bbox": bbox(0), "id": "c"}])], "drawing_id int, annotations array<struct<bbox:struct<x1:int,y1:int,x2:int,y2:int>,id:string>>")
    facts.write.parquet(str(tmp_path / "in"))
    rule = {"rule_id": "R", "name": "r", "severity": "error", "logic": {"op": "bbox_overlap_count_lte", "path": "annotations", "count": 0}}
    review.into_log(review.findings_stream(review.facts_stream(spark, str(tmp_path / "in"), facts.schema), [rule]), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    assert [(r.drawing_id, r.n_findings) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [(1, 1)]
    events = spark.sql("select timestamp'2024-01-01 00:05:00' as ts, 'open' as event_type union all select timestamp'2024-01-01 00:55:00', 'open' union all select timestamp'2024-01-01 03:00:00', 'close'")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = review.counts_by_window(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination()
    assert sorted((r.window.start.hour, r.event_type, r.n) for r in spark.table("counted").collect()) == [(0, "open", 2), (3, "close", 1)]
