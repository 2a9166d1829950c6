"""The drawing engine's queries over the test tables, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import angle as an
from .functions import geometry as g
from .functions import text as tx
from .operators import greedy, pairs, perceive, planning, plans, report, state
from .plans import rules as rl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
W, H = 2000, 1400
SQL_INST = model.INSTANCES.format(events="events")
SQL_TITLES = model.TITLES.format(orders="orders", customer="customer")
SQL_COMP = model.COMPONENTS.format(lineitem="lineitem")
SQL_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


def query(name: str, sql: str | None = None):
    """Registers a query; sql may name inst, tb and comp."""

    def add(f):
        QUERIES[name] = f
        if sql:
            used = [f"{n} as ({q})" for n, q in (("inst", SQL_INST), ("tb", SQL_TITLES), ("comp", SQL_COMP)) if f" {n} " in f"{sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
            body = sql.strip()
            if used:
                lead = next((w for w in ("with recursive ", "with ") if body.startswith(w)), "")
                body = f"{lead}{', '.join(used)}, {body[len(lead):]}" if lead else f"with {', '.join(used)} {body}"
            SQL[name] = body
        return f

    return add


def inst(spark: SparkSession, d: str) -> DataFrame:
    return model.instances(spark, d)


BOX = g.Box("x1", "y1", "x2", "y2")


# --- geometry -----------------------------------------------------------------------------------


@query("bbox_geometry", "select iid, cast(x2 - x1 as bigint) as w, cast(y2 - y1 as bigint) as h, cast((x2 - x1) * (y2 - y1) as bigint) as area, (x1 + x2) / 2.0 as cx, (y1 + y2) / 2.0 as cy from inst ")
def _(spark, d):
    return inst(spark, d).select("iid", BOX.width.cast("long").alias("w"), BOX.height.cast("long").alias("h"), BOX.area.cast("long").alias("area"), BOX.cx.alias("cx"), BOX.cy.alias("cy"))


@query("bbox_normalize", f"""select iid, greatest(0, least(least(a, c), {W - 1})) as x1, greatest(0, least(least(b, d), {H - 1})) as y1,
greatest(0, least(greatest(a, c), {W})) as x2, greatest(0, least(greatest(b, d), {H})) as y2 from (select iid,
cast(case when s then round_even(x1 * {W} / 1000.0, 0) else x1 end as int) as a, cast(case when s then round_even(y1 * {H} / 1000.0, 0) else y1 end as int) as b,
cast(case when s then round_even(x2 * {W} / 1000.0, 0) else x2 end as int) as c, cast(case when s then round_even(y2 * {H} / 1000.0, 0) else y2 end as int) as d
from (select *, greatest(x1, y1, x2, y2) <= 1001 as s from (select iid, x1 + case when iid % 7 = 0 then 200 else 0 end as x1, y1, x2 + case when iid % 7 = 0 then 200 else 0 end as x2, y2 from inst )))""")
def _(spark, d):
    rows = inst(spark, d).withColumns({c: F.col(c) + F.when(F.col("iid") % 7 == 0, 200).otherwise(0) for c in ("x1", "x2")})
    b = g.to_pixels(BOX, W, H)
    return rows.select("iid", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("bbox_expand", "select iid, greatest(0, x1 - dx) as x1, greatest(40, y1 - dy) as y1, least(950, x2 + dx) as x2, least(720, y2 + dy) as y2 from (select *, cast(trunc((x2 - x1) * 0.15) as int) as dx, cast(trunc((y2 - y1) * 0.15) as int) as dy from inst )")
def _(spark, d):
    b = g.expand(BOX, 950, 720, 0.15, y1_floor=40)
    return inst(spark, d).select("iid", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("bbox_clip", "select iid, a as x1, b as y1, greatest(a + 1, least(x2, 500)) as x2, greatest(b + 1, least(y2, 400)) as y2 from (select *, greatest(0, least(x1, 499)) as a, greatest(0, least(y1, 399)) as b from inst )")
def _(spark, d):
    b = g.clip(BOX, 500, 400)
    return inst(spark, d).select("iid", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("scale_page", "select iid, greatest(1, cast(trunc(w * s) as int)) as w, greatest(1, cast(trunc(h * s) as int)) as h, s as scale from (select *, case when greatest(w, h) <= 2048 then 1.0::double else 2048 / greatest(w, h)::double end as s from (select iid, x2 * 5 as w, y2 * 3 as h from inst ))")
def _(spark, d):
    rows = inst(spark, d).select("iid", (F.col("x2") * 5).alias("w"), (F.col("y2") * 3).alias("h"))
    w, h, s = g.page_scale(F.col("w"), F.col("h"))
    return rows.select("iid", w.alias("w"), h.alias("h"), s.alias("scale"))


def _quad() -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(BOX.x1, BOX.y1), p(BOX.x2, BOX.y1 + 3), p(BOX.x2 - 4, BOX.y2), p(BOX.x1, BOX.y2))


@query("quad_to_box", "select iid, least(x1, x2 - 4) as x1, least(y1, y1 + 3, y2) as y1, greatest(x1, x2) as x2, greatest(y1 + 3, y2) as y2 from inst ")
def _(spark, d):
    b = g.quad_box(_quad())
    return inst(spark, d).select("iid", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("angle_from_quad", """with e as (select iid, unnest([{'l': (x2-x1)*(x2-x1)+9, 'i': 0, 'dx': x2-x1, 'dy': 3}, {'l': 16+(y2-y1-3)*(y2-y1-3), 'i': 1, 'dx': -4, 'dy': y2-y1-3},
{'l': (x1-x2+4)*(x1-x2+4), 'i': 2, 'dx': x1-x2+4, 'dy': 0}, {'l': (y1-y2)*(y1-y2), 'i': 3, 'dx': 0, 'dy': y1-y2}]) as e from inst )
select iid, round(90 - ((90 - a) - 180 * floor((90 - a) / 180)), 1) as angle from (select iid, degrees(atan2(e.dy, e.dx)) as a from e qualify row_number() over (partition by iid order by e.l desc, e.i) = 1)""")
def _(spark, d):
    return inst(spark, d).select("iid", an.from_quad(_quad()).alias("angle"))


@query("angle_normalize", "select iid, round(90 - ((90 - a) - 180 * floor((90 - a) / 180.0)), 1) as angle from (select iid, cast((iid * 13) % 720 - 360 as double) as a from inst )")
def _(spark, d):
    return inst(spark, d).select("iid", an.normalize(((F.col("iid") * 13) % 720 - 360).cast("double")).alias("angle"))


@query("angle_from_bbox", "select iid, case when y2 - y1 >= 1.35 * (x2 - x1) then 90.0::double else 0.0::double end as angle from inst ")
def _(spark, d):
    return inst(spark, d).select("iid", an.from_box(BOX).alias("angle"))


@query("angle_of_instance", """select iid, round(90 - ((90 - a) - 180 * floor((90 - a) / 180.0)), 1) as angle from (select iid, coalesce(try_cast(case when iid % 4 = 0 then txt end as double), case when iid % 5 = 0 then cast(iid % 360 as double) end,
case when y2 - y1 >= 1.35 * (x2 - x1) then 90.0 else 0.0 end) as a from inst )""")
def _(spark, d):
    return inst(spark, d).select("iid", an.of_instance(F.when(F.col("iid") % 4 == 0, F.col("txt")), F.when(F.col("iid") % 5 == 0, (F.col("iid") % 360).cast("string")), BOX).alias("angle"))


def _turned_sql() -> str:
    import math

    cos, sin = (f"cast('{f(math.radians(-90))!r}' as double)" for f in (math.cos, math.sin))
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    xs = ", ".join(f"({x} - 700.0::double) * {cos} + ({y} - 1000.0::double) * {sin} + 1000.0::double" for x, y in corners)
    ys = ", ".join(f"-({x} - 700.0::double) * {sin} + ({y} - 1000.0::double) * {cos} + 700.0::double" for x, y in corners)
    return f"""with c as (select iid, {', '.join(f"cast(trunc({f}({v})) as int) as {n}" for f, v, n in (("least", xs, "a"), ("least", ys, "b"), ("greatest", xs, "c"), ("greatest", ys, "d")))} from inst ),
e as (select *, greatest(0, least(a, 1999)) as x1, greatest(0, least(b, 1399)) as y1 from c) select iid, x1, y1, greatest(x1 + 1, least(c, 2000)) as x2, greatest(y1 + 1, least(d, 1400)) as y2 from e"""


@query("rotate_box_back", _turned_sql())
def _(spark, d):
    b = g.rotate_back(BOX, 90, 1400, 2000, 2000, 1400)
    return inst(spark, d).select("iid", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


# --- rules --------------------------------------------------------------------------------------


def _rule(logic: dict, **more) -> dict:
    return {"rule_id": "R", "name": "rule", "severity": "error", "logic": logic, **more}


def _ok(spark, d, logic: dict) -> DataFrame:
    facts = model.facts(spark, d)
    x = rl.compile_logic(logic, facts.schema)
    return facts.select("drawing_id", x.ok.alias("ok"), x.actual.alias("actual"))


_BLANK = "(part_no is null or trim(part_no) = '')"
query("rule_not_empty", f"select drawing_id, not {_BLANK} as ok, part_no as actual from tb ")(lambda s, d: _ok(s, d, {"op": "not_empty", "path": "title_block.part_no"}))
query("rule_eq", "select drawing_id, material is not distinct from '1-URGENT' as ok, material as actual from tb ")(lambda s, d: _ok(s, d, {"op": "eq", "path": "title_block.material", "value": "1-URGENT"}))
query("rule_eq_number", "select drawing_id, sheet = 3 as ok, cast(sheet as varchar) as actual from tb ")(lambda s, d: _ok(s, d, {"op": "eq", "path": "title_block.sheet", "value": 3.0}))
query("rule_neq_null", "select drawing_id, part_no is distinct from 'A-1' as ok, part_no as actual from tb ")(lambda s, d: _ok(s, d, {"op": "neq", "path": "title_block.part_no", "value": "A-1"}))
query("rule_in_null", "select drawing_id, part_no is null or part_no in ('A-1', 'A-2') as ok, part_no as actual from tb ")(lambda s, d: _ok(s, d, {"op": "in", "path": "title_block.part_no", "value": ["A-1", None, "A-2"]}))
query("rule_regex", "select drawing_id, coalesce(regexp_matches(part_no, '7[0-9]'), false) as ok, part_no as actual from tb ")(lambda s, d: _ok(s, d, {"op": "regex", "path": "title_block.part_no", "pattern": "7[0-9]"}))
_COUNT = "select tb.drawing_id, coalesce(n, 0) {op} 3 as ok, cast(coalesce(n, 0) as varchar) as actual from tb left join (select drawing_id, count(*) as n from comp group by drawing_id) c on tb.drawing_id = c.drawing_id"
query("rule_count_gte", _COUNT.format(op=">="))(lambda s, d: _ok(s, d, {"op": "count_gte", "path": "components", "count": 3}))
query("rule_count_lte", _COUNT.format(op="<="))(lambda s, d: _ok(s, d, {"op": "count_lte", "path": "components", "count": 3}))
_REF = "exists (select 1 from comp c where c.drawing_id = tb.drawing_id and c.id = tb.ref)"
query("rule_ref_exists", f"select drawing_id, {_REF} as ok, ref as actual from tb ")(lambda s, d: _ok(s, d, {"op": "ref_exists", "path": "title_block.ref"}))
_NE, _RX = {"op": "not_empty", "path": "title_block.part_no"}, {"op": "regex", "path": "title_block.name", "pattern": "^B"}
query("rule_and", f"select drawing_id, not {_BLANK} and name like 'B%' as ok, case when {_BLANK} then part_no when name not like 'B%' then name end as actual from tb ")(
    lambda s, d: _ok(s, d, {"op": "and", "args": [_NE, _RX]}).withColumn("actual", F.when(~F.col("ok"), F.col("actual"))))
query("rule_or", f"select drawing_id, not {_BLANK} or name like 'B%' as ok, case when not {_BLANK} then part_no else name end as actual from tb ")(lambda s, d: _ok(s, d, {"op": "or", "args": [_NE, _RX]}))
query("rule_not", "select drawing_id, not (name like 'B%') as ok, name as actual from tb ")(lambda s, d: _ok(s, d, {"op": "not", "arg": _RX}))
query("path_list_field", "select tb.drawing_id, not (v is null) as ok, coalesce('[' || v || ']', '[]') as actual from tb left join (select drawing_id, string_agg('\"' || id || '\"', ',' order by seq) as v from comp group by drawing_id) c on tb.drawing_id = c.drawing_id")(
    lambda s, d: _ok(s, d, {"op": "not_empty", "path": "components.id.ignored"}))
query("path_index", "select tb.drawing_id, c.value is not null and trim(c.value) <> '' as ok, c.value as actual from tb left join comp c on tb.drawing_id = c.drawing_id and c.seq = 1")(lambda s, d: _ok(s, d, {"op": "not_empty", "path": "components[1].value"}))
query("is_empty_cases", "select tb.drawing_id, coalesce(full_, false) as ok from tb left join (select drawing_id, bool_or(trim(value) <> '') as full_ from comp group by drawing_id) c on tb.drawing_id = c.drawing_id")(
    lambda s, d: _ok(s, d, {"op": "not_empty", "path": "components.value"}).drop("actual"))

RULES = [
    _rule(_NE, rule_id="TB_PART_NO", message="part number", version=2),
    _rule({"op": "count_gte", "path": "components", "count": 2}, rule_id="COMP_COUNT", severity="warn", message="components", version=5, status="active"),
    _rule({"op": "ref_exists", "path": "title_block.ref"}, rule_id="TB_REF", severity="info", message="reference"),
    _rule(_RX, rule_id="OLD", status="deprecated"),
]
_FINDINGS = f"""with c as (select drawing_id, count(*) as n from comp group by drawing_id), f as (
select drawing_id, 'TB_PART_NO' as rule_id, 'error' as severity, 'part number' as message, 'title_block.part_no' as path, part_no as actual, '非空' as expected from tb where {_BLANK}
union all select tb.drawing_id, 'COMP_COUNT', 'warn', 'components', 'components', cast(coalesce(n, 0) as varchar), '>=2' from tb left join c on tb.drawing_id = c.drawing_id where coalesce(n, 0) < 2
union all select drawing_id, 'TB_REF', 'info', 'reference', 'title_block.ref', ref, '存在引用对象' from tb where not {_REF})
"""
query("rule_findings_inline", _FINDINGS + "select * from f")(lambda s, d: rl.findings(model.facts(s, d), RULES).drop("evidence_bboxes", "related_ids"))
query("rule_severity_pass", _FINDINGS + "select tb.drawing_id, 'set' as rule_set_id, 5 as rule_set_version, coalesce(not bool_or(severity = 'error'), true) as passed, cast(count(f.rule_id) as int) as n_findings from tb left join f on tb.drawing_id = f.drawing_id group by tb.drawing_id")(
    lambda s, d: rl.results(model.facts(s, d), RULES, rule_set_id="set"))
query("rule_evidence", _FINDINGS + """select f.drawing_id, f.rule_id, case when f.rule_id = 'COMP_COUNT' then coalesce(e.boxes, '[]') else '[{"x1":10,"y1":10,"x2":50,"y2":40}]' end as evidence_bboxes,
case when f.rule_id = 'COMP_COUNT' then coalesce(e.ids, '') else '' end as ids from f left join (select drawing_id, '[' || string_agg('{"x1":' || x1 || ',"y1":' || y1 || ',"x2":' || x2 || ',"y2":' || y2 || '}', ',' order by seq) || ']' as boxes, string_agg(id, ',' order by seq) as ids from comp group by drawing_id) e on f.drawing_id = e.drawing_id""")(
    lambda s, d: rl.findings(model.facts(s, d), RULES).select("drawing_id", "rule_id", "evidence_bboxes", F.array_join("related_ids", ",").alias("ids")))

#: The rule that ships: no two kept marks overlap.
OVERLAP_RULE = _rule({"op": "bbox_overlap_count_lte", "path": "annotations", "count": 0, "min_intersection": 1, "min_box_side": 8, "only_keep_pair": True}, rule_id="NUM_TEXT_NO_OVERLAP", message="overlapping numbers")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("iid", F.col("iid").cast("string").alias("instance_id"), BOX.struct().alias("bbox"), "keep_pair")
    return inst(spark, d).groupBy("drawing_id").agg(F.array_sort(F.collect_list(item)).alias("annotations"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return rl.findings(annotations(spark, d), [OVERLAP_RULE]).select("drawing_id", "rule_id", "severity", F.col("actual").cast("long").alias("overlap_pairs"), F.size("related_ids").cast("long").alias("n_ids"))


query("rule_overlap", f"""with k as (select * from inst where keep_pair and least(x2 - x1, y2 - y1) >= 8), p as (select a.drawing_id, a.iid as a, b.iid as b from k a join k b on a.drawing_id = b.drawing_id and a.iid < b.iid where {SQL_INTER} >= 1),
e as (select drawing_id, a as iid from p union select drawing_id, b from p)
select p.drawing_id, 'NUM_TEXT_NO_OVERLAP' as rule_id, 'error' as severity, count(*) as overlap_pairs, any_value(n) as n_ids from p join (select drawing_id, count(distinct (x1, y1, x2, y2)) as n from e join inst using (drawing_id, iid) group by drawing_id) m on p.drawing_id = m.drawing_id group by p.drawing_id""")(flagship)

# --- joins --------------------------------------------------------------------------------------

_PAIRS = f"select a.drawing_id, a.iid as a, b.iid as b, cast({SQL_INTER} as bigint) as inter from inst a join inst b on a.drawing_id = b.drawing_id and a.iid < b.iid where {SQL_INTER} >= 1"
query("overlap_pairs", _PAIRS)(lambda s, d: pairs.overlapping(inst(s, d)))
query("overlap_grid_bucketed", _PAIRS)(lambda s, d: pairs.overlapping(inst(s, d), cell=40))
query("overlap_keep_pair", _PAIRS + " and a.keep_pair and b.keep_pair")(lambda s, d: pairs.overlapping(inst(s, d), only_keep_pair=True))
_AREA = lambda p: f"(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1))"
_IOU = f"({SQL_INTER}) / ({_AREA('a')} + {_AREA('b')} - ({SQL_INTER}))::double"
_RATIO = f"({SQL_INTER}) / least({_AREA('a')}, {_AREA('b')})::double"
query("overlap_iou_ratio", _PAIRS + f" and {_IOU} >= 0.2 and {_RATIO} >= 0.4")(lambda s, d: pairs.overlapping(inst(s, d), iou_thr=0.2, min_ratio=0.4))
_APART, _CHAR = "abs((a.x1 + a.x2) / 2.0 - (b.x1 + b.x2) / 2.0)", "greatest(a.x2 - a.x1, b.x2 - b.x1, 1)"
_HN = f"""(abs((a.y1 + a.y2) / 2.0 - (b.y1 + b.y2) / 2.0) <= 0.45 * greatest(1, (a.y2 - a.y1 + b.y2 - b.y1) / 2.0) and greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 0.5 * least(a.y2 - a.y1, b.y2 - b.y1)
and {_APART} >= 0.55 * {_CHAR} and {_APART} <= 2.2 * {_CHAR} and least({_AREA('a')}, {_AREA('b')}) > 0 and {_RATIO} < 0.35)"""
query("overlap_h_neighbor", _PAIRS + f" and not ({_HN} and not (a.keep_pair and b.keep_pair))")(lambda s, d: pairs.overlapping(inst(s, d), skip_neighbors=True))
query("touch_pairs", "select a.drawing_id, a.iid as a, b.iid as b from inst a join inst b on a.drawing_id = b.drawing_id and a.iid < b.iid where not (a.x2 + 2 < b.x1 or b.x2 + 2 < a.x1 or a.y2 + 2 < b.y1 or b.y2 + 2 < a.y1)")(lambda s, d: pairs.touching(inst(s, d)))
query("region_anti_join", "select a.drawing_id, a.iid from inst a where not exists (select 1 from inst r where r.drawing_id = a.drawing_id and r.iid % 10 = 0 and (a.x1 + a.x2) / 2.0 between r.x1 - 6 and r.x2 + 6 and (a.y1 + a.y2) / 2.0 between r.y1 - 6 and r.y2 + 6)")(
    lambda s, d: pairs.outside(inst(s, d), inst(s, d).filter("iid % 10 = 0"), 6).select("drawing_id", "iid"))
query("existing_box_suppression", f"select a.drawing_id, a.iid from inst a where a.iid % 10 <> 0 and not exists (select 1 from inst b where b.drawing_id = a.drawing_id and b.iid % 10 = 0 and {_IOU} > 0.25)")(
    lambda s, d: pairs.not_overlapping(inst(s, d).filter("iid % 10 <> 0"), inst(s, d).filter("iid % 10 = 0"), 0.25).select("drawing_id", "iid"))
_TOKEN = "regexp_replace(lower(coalesce(txt, '')), '[^a-z0-9.+]', '', 'g')"
query("token_anti_join", f"""with k as (select *, {_TOKEN} as t from inst ), tok as (select distinct drawing_id, t as token from k where iid % 5 = 0 and length(t) >= 3)
select drawing_id, iid from k where not exists (select 1 from tok where tok.drawing_id = k.drawing_id and length(t) >= 4 and (t = token or (length(token) >= 8 and length(t) >= 6 and (contains(t, token) or contains(token, t)))))""")(
    lambda s, d: pairs.without_tokens(inst(s, d), _tokens(s, d)).select("drawing_id", "iid"))


def _tokens(spark, d) -> DataFrame:
    return inst(spark, d).filter("iid % 5 = 0").select("drawing_id", tx.table_token(F.col("txt")).alias("token")).filter(F.length("token") >= 3).distinct()


query("table_tokens", f"select distinct drawing_id, {_TOKEN} as token from inst where iid % 5 = 0 and length({_TOKEN}) >= 3")(_tokens)
query("label_above_nearest", """select drawing_id, iid, label, gap from (select v.drawing_id, v.iid, l.iid as label, l.y1 - v.y2 as gap, row_number() over (partition by v.drawing_id, v.iid order by l.y1 - v.y2, l.iid) as n
from inst v join inst l on v.drawing_id = l.drawing_id where v.iid % 4 <> 0 and l.iid % 4 = 0 and l.y1 - v.y2 between 0 and 100 and greatest(0, least(v.x2, l.x2) - greatest(v.x1, l.x1)) / least(v.x2 - v.x1, l.x2 - l.x1)::double >= 0.25) where n = 1""")(
    lambda s, d: pairs.labels_above(inst(s, d).filter("iid % 4 <> 0"), inst(s, d).filter("iid % 4 = 0")))
query("ref_semi_join", f"select drawing_id, ref from tb where {_REF}")(lambda s, d: pairs.references(model.titles(s, d), model.components(s, d), F.col("ref")).select("drawing_id", "ref"))
query("ref_anti_join", f"select drawing_id, ref from tb where not {_REF}")(lambda s, d: pairs.references(model.titles(s, d), model.components(s, d), F.col("ref"), "left_anti").select("drawing_id", "ref"))
query("evidence_boxes", f"""with p as ({_PAIRS}), e as (select drawing_id, a, b, 0 as side, a as iid from p union all select drawing_id, a, b, 1, b from p),
f as (select e.*, i.x1, i.y1, i.x2, i.y2, row_number() over (partition by e.drawing_id, x1, y1, x2, y2 order by a, b, side) as n from e join inst i on e.iid = i.iid)
select drawing_id, row_number() over (partition by drawing_id order by a, b, side) as rank, iid, x1, y1, x2, y2 from f where n = 1""")(lambda s, d: pairs.evidence_boxes(pairs.overlapping(inst(s, d)), inst(s, d)).withColumn("rank", F.col("rank").cast("long")))

# --- greedy -------------------------------------------------------------------------------------

_KX = "(greatest(0, least(k.x2, x.x2) - greatest(k.x1, x.x1)) * greatest(0, least(k.y2, x.y2) - greatest(k.y1, x.y1)))"
_KIOU = f"({_KX} / (((k.x2 - k.x1) * (k.y2 - k.y1)) + ((x.x2 - x.x1) * (x.y2 - x.y1)) - {_KX})::double)"


def _greedy_sql(keys: str, clash: str) -> str:
    return f"""with l as (select {keys}, list({{'iid': iid, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by conf desc, iid) as l from inst group by {keys})
select {keys}, unnest(list_transform(list_reduce(list_transform(l, lambda e: [e]), lambda acc, y: case when len(list_filter(acc, lambda k: list_bool_or([({clash.replace('x.', 'y[1].')})]))) > 0 then acc else list_concat(acc, y) end), lambda e: e.iid)) as iid from l"""


query("nms", _greedy_sql("drawing_id, entity_id", f"{_KIOU} >= 0.1"))(lambda s, d: greedy.nms(inst(s, d), 0.1))
query("dedupe_boxes", _greedy_sql("drawing_id", f"{_KIOU} >= 0.3"))(lambda s, d: greedy.dedupe(inst(s, d), 0.3))
_CX = lambda p, a, b: f"(({p}.{a} + {p}.{b}) / 2.0::double)"
_IN = lambda p, q: f"({_CX(p, 'x1', 'x2')} between {q}.x1 and {q}.x2 and {_CX(p, 'y1', 'y2')} between {q}.y1 and {q}.y2)"
_W = lambda p: f"greatest(1, {p}.x2 - {p}.x1)"
_H = lambda p: f"greatest(1, {p}.y2 - {p}.y1)"
_FAR = f"sqrt(({_CX('k', 'x1', 'x2')} - {_CX('x', 'x1', 'x2')}) * ({_CX('k', 'x1', 'x2')} - {_CX('x', 'x1', 'x2')}) + ({_CX('k', 'y1', 'y2')} - {_CX('x', 'y1', 'y2')}) * ({_CX('k', 'y1', 'y2')} - {_CX('x', 'y1', 'y2')}))"
_LONG = f"greatest({_W('k')}, {_H('k')}, {_W('x')}, {_H('x')}, 8)"
_NEAR_DUP = f"""(case when {_H('x')} >= 1.35::double * {_W('x')} and {_W('k')} >= 1.8::double * {_H('k')} and {_H('x')} > 1.2::double * {_H('k')} then false when {_KIOU} >= 0.35 then true
when {_IN('x', 'k')} then {_KIOU} >= 0.12 or {_W('x')} * {_H('x')} > 0.35::double * {_W('k')} * {_H('k')} when {_IN('k', 'x')} then {_KIOU} >= 0.12
else {_FAR} < 0.45::double * {_LONG} or (abs(k.iid * 13 % 181 - 90) >= 80 and abs(x.iid * 13 % 181 - 90) >= 80 and {_FAR} < 1.1::double * {_LONG}) end)"""
query("cluster_near_dup", _greedy_sql("drawing_id", _NEAR_DUP))(lambda s, d: greedy.cluster(inst(s, d).withColumn("angle", (F.col("iid") * 13) % 181 - 90)))


def _shifted(spark, d) -> DataFrame:
    return inst(spark, d).withColumns({"x1": F.col("x1") + (F.col("iid") % 9).cast("int"), "x2": F.col("x2") + (F.col("iid") % 9).cast("int")}).filter("iid % 11 <> 0")


_GOLD = """with p as (select drawing_id, entity_id, list({'iid': iid, 'x1': x1 + cast(iid % 9 as int), 'y1': y1, 'x2': x2 + cast(iid % 9 as int), 'y2': y2} order by iid) as e from inst where iid % 11 <> 0 group by all),
t as (select drawing_id, entity_id, list({'iid': iid, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} order by iid) as l from inst group by all),
m as (select drawing_id, entity_id, coalesce(len(e), 0) as np, coalesce(len(l), 0) as nt, case when e is null or l is null then 0 else
len(list_reduce(list_prepend(cast([] as bigint[]), list_transform(range(1, len(e) + 1), lambda i: [i])), lambda acc, y: list_concat(acc, list_transform(list_sort(list_transform(list_filter(l, lambda q: not list_contains(acc, q.iid) and IOU >= 0.5), lambda q: {'u': -IOU, 'i': q.iid}))[1:1], lambda b: b.i)))) end as tp from p full join t using (drawing_id, entity_id))
""".replace("IOU", _KIOU.replace("k.", "q.").replace("x.x", "e[y[1]].x").replace("x.y", "e[y[1]].y"))
query("gold_box_prf", _GOLD + "select drawing_id, entity_id, cast(tp as int) as tp, cast(np - tp as int) as fp, cast(nt - tp as int) as fn from m")(lambda s, d: greedy.match(_shifted(s, d), inst(s, d)))
query("gold_micro_rollup", _GOLD + """, r as (select drawing_id, cast(sum(tp) as bigint) as tp, cast(sum(np - tp) as bigint) as fp, cast(sum(nt - tp) as bigint) as fn from m group by rollup (drawing_id))
select *, case when tp + fp = 0 then 0.0::double else tp / (tp + fp)::double end as precision, case when tp + fn = 0 then 0.0::double else tp / (tp + fn)::double end as recall, case when tp = 0 then 0.0::double else 2 * (tp / (tp + fp)::double) * (tp / (tp + fn)::double) / (tp / (tp + fp)::double + tp / (tp + fn)::double) end as f1 from r""")(lambda s, d: _rollup(greedy.match(_shifted(s, d), inst(s, d))))


def _rollup(scores: DataFrame) -> DataFrame:
    out = scores.rollup("drawing_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return out.select("drawing_id", "tp", "fp", "fn", *[c.alias(n) for n, c in plans.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


query("merge_twins", "select drawing_id, cast(iid - iid % 4 as varchar) as parent, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as n from inst group by drawing_id, iid - iid % 4")(
    lambda s, d: greedy.merge_twins(inst(s, d).withColumn("parent_id", F.concat((F.col("iid") - F.col("iid") % 4).cast("string"), F.when(F.col("iid") % 2 == 1, "_twin").otherwise("")))))
query("angle_suggest_extra", """with recursive a as (select drawing_id, iid, cast((iid * 13) % 181 - 90 as double) as angle from inst ), b as (select drawing_id, iid, cast(round_even(angle / 15, 0) * 15 as int) as bucket from a where abs(angle) between 12 and 78),
c as (select drawing_id, -bucket as angle, row_number() over (partition by drawing_id order by count(*) desc, min(iid)) as n from b group by drawing_id, bucket having count(*) >= 2),
w as (select drawing_id, cast(0 as bigint) as n, [0, 90, -90] as known from (select distinct drawing_id from c) union all
select w.drawing_id, c.n, case when len(w.known) >= 7 or len(list_filter(w.known, lambda k: abs(k - c.angle) < 7.5)) > 0 then w.known else list_append(w.known, c.angle) end from w join c on c.drawing_id = w.drawing_id and c.n = w.n + 1)
select drawing_id, unnest(known[4:]) as angle from w qualify n = max(n) over (partition by drawing_id)""")(lambda s, d: greedy.extra_angles(inst(s, d).select("drawing_id", "iid", ((F.col("iid") * 13) % 181 - 90).cast("double").alias("angle"))))
query("reindex_instances", "select drawing_id, iid, entity_id || '#' || (row_number() over (partition by drawing_id, entity_id order by iid) - 1) as instance_id from inst ")(lambda s, d: plans.numbered(inst(s, d)).select("drawing_id", "iid", "instance_id"))
query("topk_components", "select drawing_id, iid, n from (select drawing_id, iid, cast(row_number() over (partition by drawing_id order by (x2 - x1) * (y2 - y1) desc, iid) as int) as n from inst ) where n <= 4")(lambda s, d: _topk(inst(s, d)))
query("product_row_pick", "select drawing_id, arg_max(iid, y1 * 1000000 + iid) as iid from inst where txt = 'note' group by drawing_id")(lambda s, d: inst(s, d).filter("txt = 'note'").groupBy("drawing_id").agg(F.max_by("iid", F.struct("y1", "iid")).alias("iid")))


def _topk(rows: DataFrame, k: int = 4) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("drawing_id").orderBy(BOX.area.desc(), "iid")
    return rows.select("drawing_id", "iid", F.row_number().over(w).alias("n")).filter(F.col("n") <= k)


# --- text ---------------------------------------------------------------------------------------

_T = r"trim(regexp_replace(regexp_replace(trim(translate(txt, '，．', ',.')), '\+\s*/\s*-|\+\s*-\s*', '±', 'g'), '\s+', ' ', 'g'))"
_NUM = r"[-+]?\d+(?:[.,]\d+)?"
_DIM = rf"""with t as (select *, {_T} as t from inst ), b as (select *, regexp_matches(t, '\d') as has, case when regexp_matches(t, '(?i)°|º|deg') then 'angle' when regexp_matches(t, '^[Ø⌀ФфΦφø]') then 'diameter' when regexp_matches(t, '^[Rr]\s*\d') then 'radius' else 'length' end as kind from t),
c as (select *, case when kind = 'angle' then regexp_replace(t, '(?i)(?:°|º|deg\.?)', '', 'g') when kind in ('diameter', 'radius') then substring(t, 2) else t end as body from b),
e as (select *, instr(body, '±') as pos from c), n as (select *, replace(nullif(regexp_extract(case when pos > 0 then substring(body, 1, pos - 1) else body end, '{_NUM}'), ''), ',', '.') as basic, replace(nullif(regexp_extract(case when pos > 0 then substring(body, pos + 1) end, '{_NUM}'), ''), ',', '.') as tol from e)
"""
_DIM_COLS = rf"case when has then kind end as dim_kind, case when has then coalesce(basic, case when tol is null then replace(nullif(regexp_extract(t, '{_NUM}'), ''), ',', '.') end) end as basic_size, case when has then tol end as tolerance, has and pos > 0 and (basic is not null or tol is not null) as has_tolerance"
query("dim_parse", _DIM + f"select iid, {_DIM_COLS} from n")(lambda s, d: inst(s, d).select("iid", tx.parse_dimension(F.col("txt")).alias("p")).select("iid", "p.*"))
query("dim_skip_overlap", _DIM + f"select iid, case when not keep_pair then basic_size end as basic_size, case when keep_pair then 'overlap' end as skipped from (select iid, keep_pair, {_DIM_COLS} from n)")(
    lambda s, d: inst(s, d).select("iid", F.when(~F.col("keep_pair"), tx.parse_dimension(F.col("txt"))["basic_size"]).alias("basic_size"), F.when(F.col("keep_pair"), "overlap").alias("skipped")))
query("dim_enrich", _DIM + f"select iid, case when iid % 3 = 0 then 'diameter' else dim_kind end as dim_kind, case when iid % 5 = 0 then '7' else basic_size end as basic_size, tolerance from (select iid, {_DIM_COLS} from n)")(lambda s, d: _enriched(inst(s, d)))


def _enriched(rows: DataFrame) -> DataFrame:
    p = tx.parse_dimension(F.col("txt"))
    had = lambda c, when: F.nullif(F.when(when, F.lit(c)).otherwise(F.lit("")), F.lit(""))
    return rows.select("iid", F.coalesce(had("diameter", F.col("iid") % 3 == 0), p["dim_kind"]).alias("dim_kind"), F.coalesce(had("7", F.col("iid") % 5 == 0), p["basic_size"]).alias("basic_size"), p["tolerance"].alias("tolerance"))


_L, _D = "length(regexp_replace(txt, '[^A-Za-z]', '', 'g'))", r"length(regexp_replace(txt, '[^0-9]', '', 'g'))"
query("number_mark_filter", rf"""select iid from inst where length(txt) between 1 and 40 and {_D} > 0 and not regexp_full_match(txt, '\d{{8,}}[A-Za-z]?') and not (regexp_matches(txt, '^\d{{7,}}') and not regexp_matches(txt, '[Ø⌀ФфΦφøRr±°º]'))
and not (({_L} >= 4 and {_L} >= {_D} and not regexp_matches(txt, '[Ø⌀ФфΦφøRr±°º]')) or ({_L} >= 5 and {_L} >= 2 * {_D}))""")(lambda s, d: inst(s, d).filter(tx.number_mark(F.col("txt"))).select("iid"))
query("garbled_filter", "select iid from inst where " + " or ".join(f"regexp_matches(txt, '{p}')" for p in tx.GARBLED) + " or (length(txt) - length(replace(txt, '.', '')) >= 2" + "".join(f" and not contains(txt, '{x}')" for x in tx.DOTS_EXCUSED) + ")")(lambda s, d: inst(s, d).filter(tx.garbled(F.col("txt"))).select("iid"))
query("titleish_filter", r"""select iid from inst where least(x2 - x1, y2 - y1) < 14 or greatest(x2 - x1, y2 - y1) < 34 or (y1 > 0.78 * 720 and y2 - y1 <= 26 and x2 - x1 >= 40) or regexp_full_match(txt, '\d{7,}[A-Za-z]?') or regexp_full_match(txt, '\d+\s*[:/]\s*\d+') or (regexp_full_match(txt, '\d{1,4}(\.\d{1,3})?') and greatest(x2 - x1, y2 - y1) < 45)""")(
    lambda s, d: inst(s, d).filter(tx.titleish(F.col("txt"), BOX, 720)).select("iid"))
query("table_token_norm", f"select iid, {_TOKEN} as token from inst ")(lambda s, d: inst(s, d).select("iid", tx.table_token(F.col("txt")).alias("token")))
query("heuristic_fields", r"select event_id, nullif(regexp_extract('qty 3 Ref: ' || event_type, 'Qty\s*[:：]?\s*([^\s,，;；]+)', 1), '') as other_case, nullif(regexp_extract('Ref: ' || event_type || ' x, Qty ' || cast(user_id as varchar), 'Qty\s*[:：]?\s*([^\s,，;；]+)', 1), '') as qty, nullif(regexp_extract('Ref: ' || event_type || ' x', 'Ref\s*[:：]?\s*([^\s,，;；]+)', 1), '') as ref from events")(
    lambda s, d: model.table(s, d, "events").select("event_id", tx.after_hint(F.concat(F.lit("qty 3 Ref: "), "event_type"), "Qty").alias("other_case"), tx.after_hint(F.concat(F.lit("Ref: "), "event_type", F.lit(" x, Qty "), F.col("user_id").cast("string")), "Qty").alias("qty"), tx.after_hint(F.concat(F.lit("Ref: "), "event_type", F.lit(" x")), "Ref").alias("ref")))
query("attr_label", _DIM + f"select iid, concat_ws(' | ', case when length(txt) > 9 then substring(txt, 1, 8) || '…' else txt end, dim_kind, 's=' || basic_size, '±' || tolerance, '∠' || case when y2 - y1 >= 1.35 * (x2 - x1) then '90' else '0' end, case when keep_pair then 'overlap' end) as label from (select *, {_DIM_COLS} from n)")(lambda s, d: _labels(inst(s, d)))


def _labels(rows: DataFrame) -> DataFrame:
    p = tx.parse_dimension(F.col("txt"))
    return rows.select("iid", tx.attribute_label(F.col("txt"), p["dim_kind"], p["basic_size"], p["tolerance"], an.from_box(BOX), F.col("keep_pair"), 9).alias("label"))


query("json_payload_clean", "select event_id, regexp_extract(props, '(?s)([\\[{].*[\\]}])', 1) as body from events")(
    lambda s, d: model.table(s, d, "events").select("event_id", tx.json_body(F.concat(F.lit("<think>a {b}</think>```json\n"), "props", F.lit("\n```"))).alias("body")))
query("label_norm", r"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' [mm] X-1'), '\[[^\]]*\]', ' ', 'g'), '[^a-z0-9一-鿿]+', ' ', 'g'), '\s+', ' ', 'g')) as label from part")(
    lambda s, d: model.table(s, d, "part").select("p_partkey", tx.normal_label(F.concat("p_name", F.lit(" [mm] X-1"))).alias("label")))

# --- plans, facts, scores -----------------------------------------------------------------------

query("build_facts", """select drawing_id, cast(count(*) filter (keep_pair) as int) as n_annotations, cast(count(*) filter (not keep_pair) as int) as n_features, max_by(txt, iid) as title, string_agg(cast(iid as varchar), ',' order by iid) filter (keep_pair) as ids from inst group by drawing_id""")(
    lambda s, d: inst(s, d).groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.when(F.col("keep_pair"), F.struct("iid", "txt", BOX.struct().alias("bbox"))))).alias("annotations"), F.array_sort(F.collect_list(F.when(~F.col("keep_pair"), F.struct("iid", "txt")))).alias("features"), F.max_by("txt", "iid").alias("title")).select(
        "drawing_id", F.size("annotations").alias("n_annotations"), F.size("features").alias("n_features"), "title", F.nullif(F.array_join(F.transform("annotations", lambda a: a["iid"].cast("string")), ","), F.lit("")).alias("ids")))
_ENTRIES = "select entity_id, cast(drawing_id % 3 as varchar) as locate_query, iid as seq, case when iid % 3 = 0 then txt end as hint, case when iid % 4 = 0 then conf end as backend from inst "


def _entries(spark, d) -> DataFrame:
    return inst(spark, d).select("entity_id", (F.col("drawing_id") % 3).cast("string").alias("locate_query"), F.col("iid").alias("seq"), F.when(F.col("iid") % 3 == 0, F.col("txt")).alias("hint"), F.when(F.col("iid") % 4 == 0, F.col("conf")).alias("backend"))


query("merge_plans", f"select entity_id, locate_query, max_by(hint, seq) filter (hint is not null) as hint, max_by(backend, seq) filter (backend is not null) as backend, min(seq) as seq from ({_ENTRIES}) group by all")(lambda s, d: plans.merge_plans(_entries(s, d), ("hint", "backend")))
query("collect_entities", f"""with e as (select entity_id, cast(drawing_id % 3 as varchar) as locate_query, iid as seq, case when iid % 2 = 0 then 'one' else 'many' end as cardinality, 'f' || (iid % 5) as field, case when iid % 3 = 0 then '' else txt end as parse_hint, iid % 997 = 0 as required from inst )
select f.*, c.cardinality from (select entity_id, locate_query, field, max_by(parse_hint, seq) filter (parse_hint <> '') as parse_hint, bool_or(required) as required from e group by all) f join (select entity_id, locate_query, min_by(cardinality, seq) as cardinality from e group by all) c using (entity_id, locate_query)""")(
    lambda s, d: plans.collect_entities(inst(s, d).select("entity_id", (F.col("drawing_id") % 3).cast("string").alias("locate_query"), F.col("iid").alias("seq"), F.when(F.col("iid") % 2 == 0, "one").otherwise("many").alias("cardinality"), F.concat(F.lit("f"), (F.col("iid") % 5).cast("string")).alias("field"), F.when(F.col("iid") % 3 == 0, "").otherwise(F.col("txt")).alias("parse_hint"), (F.col("iid") % 997 == 0).alias("required"))))
query("split_plan", "select iid, case when k = 'dimension_marks' and b is distinct from 'ocr' then 'vl' when e in ('number_mark', 'annotation') or k = 'dimension_marks' then 'ocr' else 'vl' end as route, coalesce(k = 'table', false) or e like '%\\_table' escape '\\' as is_table from (select iid, case iid % 4 when 0 then 'number_mark' when 1 then 'main_table' when 2 then 'annotation' else 'title' end as e, case iid % 3 when 0 then 'dimension_marks' when 1 then 'table' end as k, case iid % 5 when 0 then 'ocr' when 1 then 'vlm' end as b from inst )")(lambda s, d: _routes(inst(s, d)))


def _routes(rows: DataFrame) -> DataFrame:
    i = F.col("iid")
    e = F.when(i % 4 == 0, "number_mark").when(i % 4 == 1, "main_table").when(i % 4 == 2, "annotation").otherwise("title")
    k, b = F.when(i % 3 == 0, "dimension_marks").when(i % 3 == 1, "table"), F.when(i % 5 == 0, "ocr").when(i % 5 == 1, "vlm")
    return rows.select("iid", plans.route(e, k, b).alias("route"), plans.is_table(e, k).alias("is_table"))


def _missing(spark, d) -> DataFrame:
    rows = inst(spark, d)
    return plans.missing_required(rows.select("drawing_id", "entity_id").distinct(), rows.select("drawing_id", "entity_id", *[(F.when(F.col("iid") % 3 == 0, 0).otherwise(F.col(c))).alias(c) for c in ("x1", "y1", "x2", "y2")], (F.col("iid") % 4 == 0).alias("complete")))


_MISSING = "select drawing_id, entity_id from inst group by all having not bool_or(iid % 3 <> 0 and iid % 4 = 0)"
query("missing_required", _MISSING)(_missing)
query("hybrid_fallback", f"with m as ({_MISSING}) select iid, 'primary' as src from inst i where keep_pair and not exists (select 1 from m where m.drawing_id = i.drawing_id and m.entity_id = i.entity_id) union all select iid, 'fallback' from inst i where not keep_pair and exists (select 1 from m where m.drawing_id = i.drawing_id and m.entity_id = i.entity_id)")(
    lambda s, d: plans.hybrid(inst(s, d).filter("keep_pair").withColumn("src", F.lit("primary")), inst(s, d).filter("not keep_pair").withColumn("src", F.lit("fallback")), _missing(s, d)).select("iid", "src"))
query("dual_keep_pair", "select iid, 'vl' as src from inst where iid % 3 = 0 union all select iid, 'ocr' from inst where iid % 3 <> 0 and keep_pair")(
    lambda s, d: inst(s, d).filter("iid % 3 = 0").select("iid", F.lit("vl").alias("src")).unionByName(inst(s, d).filter("iid % 3 <> 0 and keep_pair").select("iid", F.lit("ocr").alias("src"))))
query("union_payloads", "select iid, txt, null::int as conf from inst where iid % 2 = 0 union all select iid, null, conf from inst where iid % 2 = 1")(
    lambda s, d: inst(s, d).filter("iid % 2 = 0").select("iid", "txt").unionByName(inst(s, d).filter("iid % 2 = 1").select("iid", "conf"), allowMissingColumns=True))
query("exclude_regions", f"""with e as (select drawing_id, iid, greatest(0, x1 - 2) as x1, greatest(0, y1 - 2 - case when iid % 10 = 5 then {int(0.12 * H)} else 0 end) as y1, least({W}, x2 + 2) as x2, least({H}, y2 + 2) as y2 from inst where iid % 5 = 0)
select * from e union all select drawing_id, null, min(x1), min(y1), max(x2), max(y2) from e group by drawing_id""")(
    lambda s, d: plans.exclude_regions(inst(s, d).filter("iid % 5 = 0").withColumn("material", F.col("iid") % 10 == 5), W, H))
query("tiles", """with p as (select iid, x2 * 5 as width, y2 * 3 as height from inst ), g as (select *, greatest(width, height) <= 1280 as small from p), x as (select *, unnest(case when small then [0] else range(0, width, 1024) end) as x1 from g), y as (select *, unnest(case when small then [0] else range(0, height, 1024) end) as y1 from x)
select iid, cast(x1 as int) as x1, cast(y1 as int) as y1, cast(least(width, x1 + 1280) as int) as x2, cast(least(height, y1 + 1280) as int) as y2 from y where (x1 = 0 or x1 - 1024 + 1280 < width) and (y1 = 0 or y1 - 1024 + 1280 < height)""")(
    lambda s, d: plans.tiles(inst(s, d).select("iid", (F.col("x2") * 5).alias("width"), (F.col("y2") * 3).alias("height"))).select("iid", "x1", "y1", "x2", "y2"))
query("emit_twins", """with c as (select *, y2 - y1 >= x2 - x1 as tall, greatest(2, cast(trunc((y2 - y1) * 0.72) as int)) as ch, greatest(2, cast(trunc((x2 - x1) * 0.72) as int)) as cw from inst where keep_pair)
select drawing_id, cast(iid as varchar) as parent_id, x1, y1, case when tall then x2 else x1 + cw end as x2, case when tall then y1 + ch else y2 end as y2 from c
union all select drawing_id, iid || '_twin', case when tall then x1 else x1 + cast(trunc(greatest(2, x2 - x1) * 0.28) as int) end, case when tall then y1 + cast(trunc(greatest(2, y2 - y1) * 0.28) as int) else y1 end, x2, y2 from c""")(lambda s, d: plans.twins(inst(s, d).filter("keep_pair")))
query("material_main_boundary", f"""with p as (select drawing_id, min(iid) as m, max(iid) as n from inst group by drawing_id having min(iid) < max(iid)),
q as (select p.drawing_id, a.y1 > b.y1 + 10 and a.y2 > b.y2 - 10 as flip, a, b from p join inst a on a.iid = p.m join inst b on b.iid = p.n),
r as (select drawing_id, case when flip then b.y1 else a.y1 end as m1, case when flip then b.y2 else a.y2 end as m2, case when flip then a.y1 else b.y1 end as n1, case when flip then a.y2 else b.y2 end as n2 from q),
k as (select *, greatest(80, n2 - n1) as kept, greatest(m1 + 8, n2 - greatest(80, n2 - n1) - 2) as most from r), e as (select *, case when m2 > most then greatest(m1 + 4, most) else m2 end as m_y2 from k),
u as (select *, greatest(n1, m_y2 + 2) as v from e), z as (select *, case when n2 - v < 80 then least({H}, v + kept) else n2 end as w from u)
select drawing_id, m1 as m_y1, m_y2, greatest(0, case when v >= w - 4 then greatest(0, w - 80) else v end) as n_y1, least({H}, w) as n_y2, m_y2 + 2 as y1_floor from z""")(lambda s, d: _boundary(inst(s, d)))


def _boundary(rows: DataFrame) -> DataFrame:
    ends = rows.groupBy("drawing_id").agg(F.min_by(F.struct("iid", "x1", "y1", "x2", "y2"), "iid").alias("m"), F.max_by(F.struct("iid", "x1", "y1", "x2", "y2"), "iid").alias("n")).filter("m.iid < n.iid")
    flat = ends.select("drawing_id", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "mn" for c in ("x1", "y1", "x2", "y2")])
    return plans.boundary(flat, H).select("drawing_id", "m_y1", "m_y2", "n_y1", "n_y2", "y1_floor")


def _expected(spark, d) -> DataFrame:
    return model.table(spark, d, "labels").filter("quality = 0 or toxic = 1").select(F.col("doc_id").alias("drawing_id"), F.explode(F.array(F.when(F.col("quality") == 0, "Q"), F.when(F.col("toxic") == 1, "T"))).alias("rule_id")).filter("rule_id is not null")


def _predicted(spark, d) -> DataFrame:
    x = model.table(spark, d, "documents").select(F.col("doc_id").alias("drawing_id"), F.explode(F.array(F.when(F.length("text") < 400, "Q"), F.when(F.col("text").rlike("idiot|loser"), "T"))).alias("rule_id"))
    return x.filter("rule_id is not null")


_SETS = """with e as (select doc_id as drawing_id, 'Q' as rule_id from labels where quality = 0 union all select doc_id, 'T' from labels where toxic = 1),
p as (select doc_id as drawing_id, 'Q' as rule_id from documents where length(text) < 400 union all select doc_id, 'T' from documents where regexp_matches(text, 'idiot|loser')), u as (select * from e union select * from p)
"""
query("rule_set_prf", _SETS + "select u.drawing_id, count(*) filter (e.rule_id is not null and p.rule_id is not null) as tp, count(*) filter (e.rule_id is null) as fp, count(*) filter (p.rule_id is null) as fn from u left join e using (drawing_id, rule_id) left join p using (drawing_id, rule_id) group by u.drawing_id")(
    lambda s, d: plans.rule_sets(_expected(s, d), _predicted(s, d)))
query("gold_field_em", "select drawing_id % 10 as part, sum(case when regexp_replace(a, '^\\s+|\\s+$', '', 'g') is not distinct from regexp_replace(b, '^\\s+|\\s+$', '', 'g') then 1 else 0 end)::bigint as hit, count(*) as total from (select drawing_id, part_no as a, case when drawing_id % 4 = 0 then 'x' else chr(9) || ' ' || part_no || chr(10) end as b from tb ) group by 1")(
    lambda s, d: model.titles(s, d).select("drawing_id", F.col("part_no").alias("a"), F.when(F.col("drawing_id") % 4 == 0, "x").otherwise(F.concat(F.lit("\t "), "part_no", F.lit("\n"))).alias("b")).groupBy((F.col("drawing_id") % 10).alias("part")).agg(F.sum(plans.field_match(F.col("a"), F.col("b")).cast("long")).alias("hit"), F.count(F.lit(1)).alias("total")))
query("backend_compare", _SETS + "select u.drawing_id % 3 as backend, count(*) filter (e.rule_id is not null and p.rule_id is not null) as tp, count(*) filter (e.rule_id is null) as fp, count(*) filter (p.rule_id is null) as fn from u left join e using (drawing_id, rule_id) left join p using (drawing_id, rule_id) group by 1")(
    lambda s, d: plans.rule_sets(_expected(s, d), _predicted(s, d)).groupBy((F.col("drawing_id") % 3).alias("backend")).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]))
query("batch_summary", _FINDINGS + "select passed, count(*) as n, sum(k)::bigint as n_findings from (select tb.drawing_id, coalesce(not bool_or(severity = 'error'), true) as passed, count(f.rule_id) as k from tb left join f on tb.drawing_id = f.drawing_id group by tb.drawing_id) group by passed")(
    lambda s, d: plans.summary(rl.results(model.facts(s, d), RULES)))
query("legend_counts", "select drawing_id, count(*) filter (not keep_pair) as n_ok, count(*) filter (keep_pair) as n_overlap, 'OK' || case when count(*) filter (not keep_pair) > 1 then '（' || count(*) filter (not keep_pair) || '处）' else '' end || ' / overlap' || case when count(*) filter (keep_pair) > 1 then '（' || count(*) filter (keep_pair) || '处）' else '' end as label from inst group by drawing_id")(lambda s, d: report.legend(inst(s, d)))

# --- state, mock, report ------------------------------------------------------------------------


def _keyed(spark, d) -> DataFrame:
    return inst(spark, d).select("iid", state.signature(F.when(F.col("iid") % 2 == 0, F.col("txt")), F.concat(F.lit("c"), F.col("iid").cast("string"))).alias("sig"))


query("cache_hit_miss", "with k as (select iid, substring(sha1(coalesce(case when iid % 2 = 0 then txt end, 'c' || iid)), 1, 16) as sig from inst ), c as (select distinct sig from k where iid % 3 = 0) select iid, sig, sig in (select sig from c) as hit from k")(
    lambda s, d: (lambda k, c: state.hits(k, c, ["sig"]).withColumn("hit", F.lit(True)).unionByName(state.misses(k, c, ["sig"]).withColumn("hit", F.lit(False))))(_keyed(s, d), _keyed(s, d).filter("iid % 3 = 0").select("sig").distinct()).select("iid", "sig", "hit"))


def _due(spark, d, warn: bool) -> DataFrame:
    rows = rl.results(model.facts(spark, d), RULES).withColumn("n_review", (F.col("drawing_id") % 7 == 0).cast("int"))
    return state.enqueue(rows, warn).select("drawing_id", "status")


query("review_enqueue", f"select drawing_id, 'pending' as status from tb where {_BLANK} or drawing_id % 7 = 0")(lambda s, d: _due(s, d, False))
query("review_enqueue_all", "select drawing_id, 'pending' as status from tb ")(lambda s, d: _due(s, d, True))
query("review_latest", "select user_id as drawing_id, arg_max(event_type, {'ts': ts, 'event_id': event_id}) as event_type, max_by(event_id, {'ts': ts, 'event_id': event_id}) as event_id from events group by user_id")(
    lambda s, d: state.latest(model.table(s, d, "events").select(F.col("user_id").alias("drawing_id"), "ts", "event_id", "event_type")).select("drawing_id", "event_type", "event_id"))
query("rule_version_bump", "select 'r' || cast(user_id % 40 as varchar) as rule_id, cast(coalesce(max(case when user_id % 40 < 30 then event_id % 9 end), 0) + 1 as int) as version from events group by 1")(
    lambda s, d: (lambda e: state.next_versions(e.filter("user_id % 40 < 30").select("rule_id", (F.col("event_id") % 9).alias("version")), e.select("rule_id").distinct()))(model.table(s, d, "events").withColumn("rule_id", F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")))))
_PLAN = "(values ('info_table', 0.1, 0.2, 0.5, 0.6), ('number_mark', 0.3, 0.3, 0.4, 0.35)) as p(entity_id, fx1, fy1, fx2, fy2)"
query("mock_perceive", f"""select g.iid as drawing_id, entity_id, case when o then 1 else cast(trunc(fx1::double * w) as int) end as x1, case when o then 2 else cast(trunc(fy1::double * h) as int) end as y1, case when o then 3 else cast(trunc(fx2::double * w) as int) end as x2, case when o then 4 else cast(trunc(fy2::double * h) as int) end as y2,
case when o then 1.0::double else 0.5::double end as confidence, not o as needs_review from (select *, iid % 6 = 0 and entity_id = 'info_table' as o from (select iid, x2 * 5 as w, y2 * 3 as h from inst ) i, {_PLAN}) g""")(lambda s, d: _mock(s, d))


def _mock(spark, d) -> DataFrame:
    pages = inst(spark, d).select(F.col("iid").alias("drawing_id"), (F.col("x2") * 5).alias("width"), (F.col("y2") * 3).alias("height"))
    plan = spark.createDataFrame([("info_table", 0.1, 0.2, 0.5, 0.6), ("number_mark", 0.3, 0.3, 0.4, 0.35)], "entity_id string, fx1 double, fy1 double, fx2 double, fy2 double")
    over = pages.filter("drawing_id % 6 = 0").select("drawing_id", F.lit("info_table").alias("entity_id"), *[F.lit(v).alias(c) for v, c in enumerate(("x1", "y1", "x2", "y2"), 1)])
    return perceive.mock(pages, plan, over)


query("draw_list", _FINDINGS + """, e as (select f.drawing_id, unnest(case when f.rule_id = 'COMP_COUNT' then c.boxes else [{'x1': 10, 'y1': 10, 'x2': 50, 'y2': 40}] end) as b from f left join (select drawing_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) as boxes from comp group by drawing_id) c on f.drawing_id = c.drawing_id)
select drawing_id, 1 as z, case when keep_pair then 'overlap' else 'attribute' end as kind, x1, y1, x2, y2, case when keep_pair then '#dc1e1e' else '#1ea01e' end as color from inst union all select drawing_id, 3, 'finding', b.x1, b.y1, b.x2, b.y2, '#ff0000' from e""")(lambda s, d: _drawn(s, d))


def _drawn(spark, d) -> DataFrame:
    """All boxes, and the evidence of the rules' findings."""
    boxes = F.from_json("evidence_bboxes", "array<struct<x1:int,y1:int,x2:int,y2:int>>")
    return report.draw_list(inst(spark, d), rl.findings(model.facts(spark, d), RULES).select("drawing_id", F.inline(boxes)))


query("markdown_report", _FINDINGS + "select tb.drawing_id, '# ' || tb.drawing_id || chr(10) || coalesce(m.body, '无违规项。') as markdown from tb left join (select drawing_id, string_agg('| | ' || rule_id || ' | ' || severity || ' | ' || message, chr(10) order by rule_id) as body from f group by drawing_id) m on tb.drawing_id = m.drawing_id")(
    lambda s, d: report.markdown(model.titles(s, d).select("drawing_id"), rl.findings(model.facts(s, d), RULES)))

# --- fuzzy, pixels ------------------------------------------------------------------------------


@query("label_match_fuzzy")
def _(spark, d):
    from .operators import fuzzy

    part = model.table(spark, d, "part").select("p_partkey", tx.normal_label(F.col("p_name")).alias("label"))
    return part.select("p_partkey", fuzzy.match_label(F.col("label"), F.array(F.substring("label", 1, 12), F.reverse("label"))).alias("score"))


@query("json_payload_salvage", "select event_id, '[' || props || ']' as body from (select event_id, props from events)")
def _(spark, d):
    from .operators import fuzzy

    cut = F.concat(F.lit("["), "props", F.lit(', {"cut": '))
    return model.table(spark, d, "events").select("event_id", fuzzy.salvaged(cut).alias("body"))


_INKED = "(x * 7 + y * 3) % 5 <> 0"
query("ink_overlap_stats", f"""with c as (select iid, unnest(range(x1, x2)) as x, y1, y2 from inst where x2 > x1 and y2 > y1), k as (select iid, x, unnest(range(y1, y2)) as y from c), s as (select iid, count(*) as ink from k where {_INKED} group by iid),
p as (select a.drawing_id, a.iid as a, b.iid as b, greatest(a.x1, b.x1) as x1, greatest(a.y1, b.y1) as y1, least(a.x2, b.x2) as x2, least(a.y2, b.y2) as y2 from inst a join inst b on a.drawing_id = b.drawing_id and a.iid < b.iid and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2),
u as (select a, b, drawing_id, unnest(range(x1, x2)) as x, y1, y2 from p), v as (select a, b, drawing_id, x, unnest(range(y1, y2)) as y from u), n as (select drawing_id, a, b, count(*) as inter from v where {_INKED} group by all)
select n.*, inter / least(sa.ink, sb.ink)::double as ratio from n join s sa on sa.iid = n.a join s sb on sb.iid = n.b""")(lambda s, d: _ink(s, d))


def _ink(spark, d) -> DataFrame:
    """All boxes at full width and height."""
    from .operators import pixels

    return pixels.ink_pairs(inst(spark, d), lambda x, y: (x * 7 + y * 3) % 5 != 0)


# --- plans with fields, title blocks, fields above labels, review --------------------------------

_FIELD = "select entity_id, cast(drawing_id % 3 as varchar) as locate_query, iid as seq, 0 as pos, 'f' || cast(iid % 5 as varchar) as name, case when iid % 3 = 0 then txt when iid % 3 = 1 then '' end as hint, iid % 41 = 0 as required, case when iid % 7 = 0 then 'size_position' end as locate from inst "
query("merge_plan_fields", f"""with e as ({_FIELD} union all select entity_id, cast(drawing_id % 3 as varchar), iid, 1, 'last', null, false, null from inst where iid % 2 = 0)
select entity_id, locate_query, string_agg(name || ':' || coalesce(hint, name) || ':' || cast(required as varchar) || ':' || coalesce(locate, 'label'), ';' order by seq, pos) as fields from (
select entity_id, locate_query, name, min(seq) as seq, arg_min(pos, seq) as pos, arg_max(hint, seq) filter (coalesce(hint, '') <> '') as hint, bool_or(required) as required, arg_max(locate, seq) filter (locate is not null) as locate from e group by all) group by all""".replace("group by all) group by all", "group by entity_id, locate_query, name) group by entity_id, locate_query"))(lambda s, d: _plan_fields(s, d))


def _plan_fields(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    field = F.struct(F.concat(F.lit("f"), (F.col("iid") % 5).cast("string")).alias("name"), F.when(F.col("iid") % 3 == 0, F.col("txt")).when(F.col("iid") % 3 == 1, "").alias("parse_hint"), (F.col("iid") % 41 == 0).alias("required"), F.when(F.col("iid") % 7 == 0, "size_position").alias("locate_by"))
    last = F.struct(F.lit("last").alias("name"), none.alias("parse_hint"), F.lit(False).alias("required"), none.alias("locate_by"))
    entries = inst(spark, d).select("entity_id", (F.col("drawing_id") % 3).cast("string").alias("locate_query"), F.col("iid").alias("seq"), F.when(F.col("iid") % 2 == 0, F.array(field, last)).otherwise(F.array(field)).alias("fields"))
    told = lambda f: F.concat_ws(":", f["name"], f["parse_hint"], f["required"].cast("string"), f["locate_by"])
    return planning.merge_fields(entries).select("entity_id", "locate_query", F.array_join(F.transform("fields", told), ";").alias("fields"))


query("title_block_split", f"""with s as (select drawing_id, min(x1) as a, min(y1) as b, max(x2) as c, max(y2) as d from inst where iid % 3 = 0 and x2 > x1 and y2 > y1 group by drawing_id),
p as (select s.*, i.y1 from s join inst i on s.drawing_id = i.drawing_id where i.txt = 'note' and (i.x1 + i.x2) / 2.0 between greatest(0, a - 12) and least({W}, c + 12) and (i.y1 + i.y2) / 2.0 between greatest(0, b - 40) and least({H}, d + 12)),
q as (select drawing_id, a, b, c, d, max(y1) as y from p group by all), r as (select *, least(greatest(0, b - 12), greatest(0, y - 4)) as t from q)
select drawing_id, y as product_y, greatest(0, a - 12) as m_x1, t as m_y1, least({W}, c + 12) as m_x2, greatest(t + 4, y) as m_y2, greatest(0, a - 12) as n_x1, y as n_y1, least({W}, c + 12) as n_x2, least({H}, d + 12) as n_y2 from r""")(
    lambda s, d: planning.title_split(inst(s, d).filter("iid % 3 = 0"), inst(s, d).withColumn("text", F.when(F.col("txt") == "note", "Product no.").otherwise(F.concat(F.lit("byproducts "), "txt"))), W, H))


@query("fields_above_labels")
def _(spark, d):
    """Every page as a table: notes are its labels, one field each for three forms of them."""
    rows = inst(spark, d).withColumn("text", F.when(F.col("txt") == "note", F.element_at(F.array(F.lit("Weight"), F.lit("surfoce"), F.lit("Article number")), ((F.col("iid") / 6).cast("int") % 3 + 1).cast("int"))).otherwise(F.col("txt")))
    fields = spark.createDataFrame([(0, "weight"), (1, "surface"), (2, "article_no")], "seq int, name string")
    tables = rows.select(F.col("drawing_id").alias("table_id")).distinct()
    each = perceive.with_each(tables, fields).withColumn("aliases", tx.field_aliases(F.lit(None).cast("string"), F.col("name")))
    return planning.fields_above_labels(rows.withColumnRenamed("drawing_id", "table_id"), each)


query("review_resolve", f"""select drawing_id, case when drawing_id % 3 = 0 then 'resolved' else 'pending' end as status, case when drawing_id % 3 = 0 then 'approve' end as decision, case when drawing_id % 3 = 0 then 'human' end as reviewer from tb where {_BLANK} or drawing_id % 7 = 0""")(
    lambda s, d: (lambda due: state.resolve(due, due.filter("drawing_id % 3 = 0").select("drawing_id", F.lit("approve").alias("decision"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("comment"))).select("drawing_id", "status", "decision", "reviewer"))(_due(s, d, False)))
query("review_pending", f"select drawing_id from tb where ({_BLANK} or drawing_id % 7 = 0) and drawing_id % 3 <> 0")(
    lambda s, d: (lambda due: state.pending(state.resolve(due, due.filter("drawing_id % 3 = 0").select("drawing_id", F.lit("reject").alias("decision"), F.lit("r").alias("reviewer"), F.lit("").alias("comment")))).select("drawing_id"))(_due(s, d, False)))
query("review_warned", "select o.drawing_id from (select tb.drawing_id, count(c.seq) as n from tb left join comp c on tb.drawing_id = c.drawing_id group by tb.drawing_id) o join tb on o.drawing_id = tb.drawing_id where n < 2 or part_no is null or trim(part_no) = ''")(
    lambda s, d: _warned(s, d))


def _warned(spark, d) -> DataFrame:
    facts = model.facts(spark, d)
    warned = rl.findings(facts, RULES).groupBy("drawing_id").agg(F.count_if(F.col("severity") == "warn").alias("n_warn"))
    rows = rl.results(facts, RULES).withColumn("n_review", F.lit(0)).join(warned, "drawing_id", "left").withColumn("n_warn", F.coalesce("n_warn", F.lit(0)))
    return state.enqueue(rows, False).select("drawing_id")


query("entities_in_doubt", "select distinct drawing_id, entity_id from inst where iid % 9 = 0")(lambda s, d: state.in_doubt(inst(s, d).withColumn("needs_review", F.col("iid") % 9 == 0)))
query("field_aliases", r"""select p_partkey, list_distinct(list_filter([trim(regexp_replace(regexp_replace(lower(regexp_extract(p_type, '^[^ ]+')), '[^a-z0-9一-鿿]+', ' ', 'g'), '\s+', ' ', 'g')), 'weight', 'mass', 'veight', 'eight'], lambda x: length(x) > 0)) as a from part""".replace("as a from part", "as l from part").replace("select p_partkey, list_distinct", "select p_partkey, array_to_string(list_sort(list_distinct").replace("length(x) > 0)) as l", "length(x) > 0))), ',') as aliases"))(
    lambda s, d: model.table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.field_aliases(F.concat(F.regexp_extract("p_type", "^[^ ]+", 0), F.lit("重量说明/no label")), F.lit("weight"))), ",").alias("aliases")))
query("merge_pairs_by_iou")(lambda s, d: greedy.merge_by_iou(inst(s, d)))

# --- the rule on neighbours, pairs by IoU -------------------------------------------------------

NEIGHBOR_RULE = _rule({"op": "bbox_overlap_count_lte", "path": "annotations", "count": 3, "min_intersection": 4, "min_box_side": 6, "min_overlap_ratio": 0.05, "ignore_horizontal_neighbors": True}, rule_id="NO_OVERLAP_BUT_NEIGHBORS", message="overlaps")
query("rule_overlap_neighbors", f"""with k as (select * from inst where least(x2 - x1, y2 - y1) >= 6), p as (select a.drawing_id, a.iid as a, b.iid as b from k a join k b on a.drawing_id = b.drawing_id and a.iid < b.iid where {SQL_INTER} >= 4 and {_RATIO} >= 0.05 and not ({_HN} and not (a.keep_pair and b.keep_pair))),
e as (select drawing_id, a as iid from p union select drawing_id, b from p)
select p.drawing_id, 'NO_OVERLAP_BUT_NEIGHBORS' as rule_id, 'error' as severity, count(*) as overlap_pairs, any_value(n) as n_ids from p join (select drawing_id, count(distinct (x1, y1, x2, y2)) as n from e join inst using (drawing_id, iid) group by drawing_id) m on p.drawing_id = m.drawing_id group by p.drawing_id having count(*) > 3""")(
    lambda s, d: rl.findings(annotations(s, d), [NEIGHBOR_RULE]).select("drawing_id", "rule_id", "severity", F.col("actual").cast("long").alias("overlap_pairs"), F.size("related_ids").cast("long").alias("n_ids")))
