"""Rules compiled to Catalyst expressions.

A rule's logic is a tree of operators over paths into the facts. compile_logic turns it into
three Columns (ok, actual, expected): ok is never null, the others are strings (JSON for arrays
and structs). Types come from the DataFrame's schema when the rule is compiled, so a rule that
can't be right fails before any data is read. All rules of a set become one projection.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box, horizontal_neighbors, intersection, iou, small_ratio
from ..operators.pairs import KEYS, at_home, celled
from ..functions.text import is_blank

LEAVES = ("not_empty", "eq", "neq", "in", "regex", "count_gte", "count_lte", "bbox_overlap_count_lte", "ref_exists")
OPERATORS = ("and", "or", "not", *LEAVES)
POOLS = ("components", "features", "annotations", "datums")


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass
class Outcome:
    ok: Column
    actual: Column
    expected: Column
    boxes: Column | None = None
    ids: Column | None = None


def at_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """The Column of a path such as a.b, a[0].b and its type. A name on a list gives the list of that
    field, and what follows is not looked at; what is missing is null."""
    value: Column | None = None
    kind: T.DataType = schema
    for step in path.split("."):
        m = re.fullmatch(r"([^\[\]]+)(?:\[(\d+)\])?", step)
        if not m:
            raise RuleError(f"path {path!r}: step {step!r}")
        name, index = m[1], m[2]
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if not isinstance(inner, T.StructType) or name not in inner.names:
                return F.transform(value, lambda x: F.lit(None).cast("string")), T.ArrayType(T.StringType())
            return F.transform(value, lambda x: x[name]), T.ArrayType(inner[name].dataType)
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast("string"), T.StringType()
        value = F.col(f"`{name}`") if value is None else value[name]
        kind = kind[name].dataType
        if index is not None:
            if not isinstance(kind, T.ArrayType):
                return F.lit(None).cast("string"), T.StringType()
            value, kind = F.get(value, F.lit(int(index))), kind.elementType
    return value, kind


def empty(value: Column, kind: T.DataType) -> Column:
    """Null, blank, or a list whose every element is empty; 0 and false are not."""
    if isinstance(kind, T.StringType):
        return is_blank(value)
    if isinstance(kind, T.ArrayType):
        return value.isNull() | F.coalesce(F.forall(value, lambda x: empty(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def shown(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")


def _equal(value: Column, kind: T.DataType, wanted) -> Column:
    """Whether the value is the literal: numbers by value, true as 1, a text only a text."""
    if wanted is None:
        return value.isNull()
    if isinstance(wanted, list):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        same = [_equal(F.get(value, F.lit(i)), kind.elementType, w) for i, w in enumerate(wanted)]
        out = F.coalesce(F.size(value) == len(wanted), F.lit(False))
        for s in same:
            out = out & s
        return out
    number = isinstance(kind, (T.NumericType, T.BooleanType))
    if isinstance(wanted, (bool, int, float)):
        return value.cast("double").eqNullSafe(F.lit(float(wanted))) if number else F.lit(False)
    return value.eqNullSafe(F.lit(wanted)) if isinstance(kind, T.StringType) else F.lit(False)


def _count(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType)):
        n = F.size(value)
    elif isinstance(kind, T.StructType):
        n = F.when(value.isNotNull(), F.lit(len(kind.names)))
    elif isinstance(kind, T.StringType):
        n = F.char_length(value)
    else:
        n = F.lit(0)
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))


def overlaps(items: Column, kind: T.StructType, logic: dict) -> Column:
    """struct<n, boxes, ids> of the overlapping pairs of a list of objects with bbox: pairs in list order,
    boxes once by value in the order they are first met."""
    has = set(kind.names)
    indexed = F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    size = logic.get("min_box_side", 0.0)
    fits = lambda e: (e["x"]["bbox"].isNotNull()) & (F.least(Box.of(e["x"]["bbox"]).width, Box.of(e["x"]["bbox"]).height) >= size) & (F.coalesce(e["x"]["keep_pair"], F.lit(False)) if logic.get("only_keep_pair") and "keep_pair" in has else F.lit(not logic.get("only_keep_pair")))
    name = lambda e: F.coalesce(*[F.nullif(e["x"][k].cast("string"), F.lit("")) for k in ("instance_id", "id") if k in has], F.concat(F.lit("#"), e["i"].cast("string")))
    kept = F.filter(indexed, fits)

    def met(p: Column, q: Column) -> Column:
        a, b = Box.of(p["x"]["bbox"]), Box.of(q["x"]["bbox"])
        hit = (intersection(a, b) >= logic.get("min_intersection", 1.0)) & (iou(a, b) >= logic.get("iou_thr", 0.0)) & (small_ratio(a, b) >= logic.get("min_overlap_ratio", 0.0))
        if logic.get("ignore_horizontal_neighbors"):
            both = F.coalesce(p["x"]["keep_pair"] & q["x"]["keep_pair"], F.lit(False)) if "keep_pair" in has else F.lit(False)
            family = (p["x"]["parent_id"] == q["x"]["parent_id"]) if "parent_id" in has else F.lit(False)
            hit = hit & ~(horizontal_neighbors(a, b) & (~both | F.coalesce(family, F.lit(False))))
        return (p["i"] < q["i"]) & hit

    pairs = F.flatten(F.transform(kept, lambda p: F.transform(F.filter(kept, lambda q: met(p, q)), lambda q: F.struct(F.struct(p["x"]["bbox"].alias("bbox"), name(p).alias("id")).alias("a"), F.struct(q["x"]["bbox"].alias("bbox"), name(q).alias("id")).alias("b")))))
    ends = F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))
    boxes = F.array_distinct(F.transform(ends, lambda e: e["bbox"]))
    ids = F.transform(boxes, lambda b: F.get(F.filter(ends, lambda e: e["bbox"] == b), F.lit(0))["id"])
    return F.struct(F.size(pairs).alias("n"), boxes.alias("boxes"), ids.alias("ids"))


#: In a rule's logic, the column that already holds its overlaps.
FOUND = "__found"


def overlap_table(facts: DataFrame, key: str, logic: dict) -> DataFrame | None:
    """(key, found) with the overlaps of each row that has any, by a grid join of the boxes; None where the
    logic's list has no boxes or pairs needn't meet, which the projection does."""
    value, kind = at_path(facts.schema, logic["path"])
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType) or "bbox" not in kind.elementType.names or logic.get("min_intersection", 1.0) <= 0:
        return None
    has = set(kind.elementType.names)
    x = F.col("x")
    items = facts.select(F.col(key).alias("drawing_id"), F.posexplode(value).alias("i", "x"))
    name = F.coalesce(*[F.nullif(x[k].cast("string"), F.lit("")) for k in ("instance_id", "id") if k in has], F.concat(F.lit("#"), F.col("i").cast("string")))
    keep = F.coalesce(x["keep_pair"], F.lit(False)) if "keep_pair" in has else F.lit(False)
    family = x["parent_id"].cast("string") if "parent_id" in has else F.lit(None).cast("string")
    rows = items.select("drawing_id", "i", x["bbox"].alias("bbox"), name.alias("id"), keep.alias("keep"), family.alias("parent")).filter("bbox is not null")
    own = Box.of(F.col("bbox"))
    rows = rows.filter(F.least(own.width, own.height) >= logic.get("min_box_side", 0.0))
    if logic.get("only_keep_pair"):
        rows = rows.filter("keep")
    left, right = (celled(rows.select("drawing_id", *[F.col(c).alias(f"{p}_{c}") for c in ("i", "bbox", "id", "keep", "parent")]), Box.of(F.col(f"{p}_bbox"))) for p in "ab")
    a, b = Box.of(F.col("a_bbox")), Box.of(F.col("b_bbox"))
    hit = (F.col("a_i") < F.col("b_i")) & at_home(a, b) & (intersection(a, b) >= logic.get("min_intersection", 1.0))
    hit = hit & (iou(a, b) >= logic.get("iou_thr", 0.0)) & (small_ratio(a, b) >= logic.get("min_overlap_ratio", 0.0))
    if logic.get("ignore_horizontal_neighbors"):
        same = F.coalesce(F.col("a_parent") == F.col("b_parent"), F.lit(False))
        hit = hit & ~(horizontal_neighbors(a, b) & (~(F.col("a_keep") & F.col("b_keep")) | same))
    met = left.join(right, KEYS).filter(hit)
    ends = met.select("drawing_id", "a_i", "b_i", F.posexplode(F.array(*[F.struct(F.col(f"{p}_bbox").alias("bbox"), F.col(f"{p}_id").alias("id")) for p in "ab"])).alias("side", "end"))
    # Boxes once by value, in the order they are first met.
    once = ends.groupBy("drawing_id", F.col("end.bbox").alias("bbox")).agg(F.min(F.struct("a_i", "b_i", "side", "end.id")).alias("first"), F.count_if(F.col("side") == 0).alias("pairs"))
    lists = once.groupBy("drawing_id").agg(F.sum("pairs").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("first", "bbox"))).alias("l"))
    found = F.struct("n", F.transform("l", lambda e: e["bbox"]).alias("boxes"), F.transform("l", lambda e: e["first"]["id"]).alias("ids"))
    return lists.select(F.col("drawing_id").alias(key), found.alias("found"))


def with_overlaps(facts: DataFrame, rules: Iterable[dict], key: str) -> tuple[DataFrame, list[dict]]:
    """facts with a column for each overlap logic of the active rules, and the rules that refer to them. A stream of
    facts stays as it is: there the projection finds overlaps, which needs no state."""
    if facts.isStreaming:
        return facts, list(rules)

    def placed(logic):
        nonlocal facts
        if not isinstance(logic, dict):
            return logic
        out = dict(logic)
        if isinstance(logic.get("args"), list):
            out["args"] = [placed(x) for x in logic["args"]]
        if "arg" in logic:
            out["arg"] = placed(logic["arg"])
        if logic.get("op") == "bbox_overlap_count_lte" and logic.get("path") and isinstance(logic.get("count"), int):
            table, name = overlap_table(facts, key, logic), f"__overlaps_{len(facts.columns)}"
            if table is not None:
                none = F.struct(F.lit(0).alias("n"), F.array().alias("boxes"), F.array().alias("ids")).cast(table.schema["found"].dataType)
                facts = facts.join(table.withColumnRenamed("found", name), key, "left").withColumn(name, F.coalesce(name, none))
                out[FOUND] = name
        return out

    rules = [dict(r) | ({"logic": placed(r["logic"])} if r.get("logic") and r.get("status", "active") in (None, "", "active") else {}) for r in rules]
    return facts, rules


def compile_logic(logic: dict, schema: T.StructType) -> Outcome:
    if not isinstance(logic, dict) or logic.get("op") not in OPERATORS:
        raise RuleError(f"logic: {logic!r}")
    op = logic["op"]
    if op in ("and", "or"):
        parts = [compile_logic(x, schema) for x in logic.get("args", [])]
        if not parts:
            return Outcome(F.lit(op == "and"), F.lit("[]" if op == "and" else None).cast("string"), F.lit("all true" if op == "and" else None).cast("string"))
        stop = (lambda p: ~p.ok) if op == "and" else (lambda p: p.ok)
        ok, actual, expected = F.lit(op == "and"), F.to_json(F.array(*[p.actual for p in parts])), F.lit("all true")
        if op == "or":
            actual, expected = parts[-1].actual, parts[-1].expected
        for p in reversed(parts):
            ok = p.ok & ok if op == "and" else p.ok | ok
            actual, expected = F.when(stop(p), p.actual).otherwise(actual), F.when(stop(p), p.expected).otherwise(expected)
        return Outcome(ok, actual, expected)
    if op == "not":
        if "arg" not in logic:
            raise RuleError("not: arg is missing")
        x = compile_logic(logic["arg"], schema)
        return Outcome(~x.ok, x.actual, F.concat(F.lit("not("), F.coalesce(x.expected, F.lit("None")), F.lit(")")), x.boxes, x.ids)
    if not logic.get("path"):
        raise RuleError(f"{op}: path is missing")
    value, kind = at_path(schema, logic["path"])
    actual = shown(value, kind)
    lit = lambda x: F.lit(x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)).cast("string")
    if op == "not_empty":
        return Outcome(~empty(value, kind), actual, F.lit("非空"))
    if op in ("eq", "neq"):
        same = _equal(value, kind, logic.get("value"))
        return Outcome(same, actual, lit(logic.get("value"))) if op == "eq" else Outcome(~same, actual, F.lit(f"!={logic.get('value')}"))
    if op == "in":
        if not isinstance(logic.get("value"), list):
            raise RuleError("in: value must be a list")
        found = F.lit(False)
        for x in logic["value"]:
            found = found | _equal(value, kind, x)
        return Outcome(found, actual, lit(logic["value"]))
    if op == "regex":
        if logic.get("pattern") is None:
            raise RuleError("regex: pattern is missing")
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            raise RuleError("regex: the path gives a list or object")
        return Outcome(F.coalesce(value.cast("string").rlike("(?U)" + logic["pattern"]), F.lit(False)), actual, F.lit(logic["pattern"]))
    if op in ("count_gte", "count_lte", "bbox_overlap_count_lte") and not isinstance(logic.get("count"), int):
        raise RuleError(f"{op}: count is missing")
    if op in ("count_gte", "count_lte"):
        n = _count(value, kind)
        sign = ">=" if op == "count_gte" else "<="
        return Outcome(n >= logic["count"] if sign == ">=" else n <= logic["count"], n.cast("string"), F.lit(f"{sign}{logic['count']}"))
    if op == "bbox_overlap_count_lte" and logic.get(FOUND):
        found = F.col(logic[FOUND])
        return Outcome(found["n"] <= logic["count"], found["n"].cast("string"), F.lit(f"重叠对数<={logic['count']}"), F.to_json(found["boxes"]), found["ids"])
    if op == "bbox_overlap_count_lte":
        if not isinstance(kind, T.ArrayType):
            value, kind = F.when(value.isNotNull(), F.array(value)).otherwise(F.array()), T.ArrayType(kind)
        if not isinstance(kind.elementType, T.StructType) or "bbox" not in kind.elementType.names:
            found = F.struct(F.lit(0).alias("n"), F.array().alias("boxes"), F.array().cast("array<string>").alias("ids"))
        else:
            found = overlaps(F.coalesce(value, F.array().cast(kind)), kind.elementType, logic)
        return Outcome(found["n"] <= logic["count"], found["n"].cast("string"), F.lit(f"重叠对数<={logic['count']}"), F.to_json(found["boxes"]), found["ids"])
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return Outcome(F.lit(False), actual, F.lit("存在引用对象"))
    found = F.lit(False)
    for pool in POOLS:
        if pool in schema.names and isinstance(schema[pool].dataType, T.ArrayType):
            for key in ("id", "instance_id"):
                if key in schema[pool].dataType.elementType.names:
                    found = found | F.coalesce(F.array_contains(F.transform(F.col(pool), _getter(key)), value), F.lit(False))
    if "title_block" in schema.names:
        for key in ("id", "instance_id"):
            if key in schema["title_block"].dataType.names:
                found = found | F.coalesce(F.col("title_block")[key] == value, F.lit(False))
    return Outcome(~empty(value, kind) & found, actual, F.lit("存在引用对象"))


def _getter(key: str):
    return lambda x: x[key]


def first_path(logic: dict) -> str:
    """A logic's own path, else that of its arg, else the first of its args."""
    if logic.get("path"):
        return logic["path"]
    if isinstance(logic.get("arg"), dict):
        return first_path(logic["arg"])
    return next((p for x in logic.get("args", []) if (p := first_path(x))), "")


def evidence(schema: T.StructType, path: str) -> tuple[Column, Column]:
    """(boxes as JSON, ids) of the objects at a path's root."""
    root = path.split(".", 1)[0]
    none = F.lit("[]"), F.array().cast("array<string>")
    if root not in schema.names:
        return none
    kind, col = schema[root].dataType, F.col(root)
    if isinstance(kind, T.StructType):
        kind, col = T.ArrayType(kind), F.array(col)
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return none
    names = kind.elementType.names
    boxes = F.to_json(F.filter(F.transform(col, lambda x: x["bbox"]), lambda b: b.isNotNull())) if "bbox" in names else none[0]
    keys = [k for k in ("instance_id", "id") if k in names]
    ids = F.filter(F.transform(col, lambda x: F.coalesce(*[F.nullif(x[k].cast("string"), F.lit("")) for k in keys])), lambda i: i.isNotNull()) if keys else none[1]
    return F.coalesce(boxes, none[0]), F.coalesce(ids, none[1])


def validate(rule: dict) -> list[str]:
    """What is wrong with a rule's shape, sorted."""
    out = [f"{k} is missing" for k in ("rule_id", "name", "severity", "logic") if not rule.get(k)]
    if rule.get("severity") not in (None, "error", "warn", "info"):
        out.append("severity is unknown")
    if rule.get("status") not in (None, "draft", "active", "deprecated", "invalid"):
        out.append("status is unknown")

    def walk(x, at: str) -> None:
        if not isinstance(x, dict) or x.get("op") not in OPERATORS:
            out.append(f"{at}: unknown operator")
        elif x["op"] in ("and", "or"):
            if not x.get("args"):
                out.append(f"{at}: args are missing")
            for i, a in enumerate(x.get("args") or []):
                walk(a, f"{at}.args[{i}]")
        elif x["op"] == "not":
            walk(x.get("arg"), f"{at}.arg")
        else:
            needs = {"eq": "value", "neq": "value", "in": "value", "regex": "pattern", "count_gte": "count", "count_lte": "count", "bbox_overlap_count_lte": "count"}
            out.extend(f"{at}: {k} is missing" for k in ("path", needs.get(x["op"])) if k and k not in x)

    walk(rule.get("logic"), "logic")
    return sorted(out)


def outcomes(rules: Iterable[dict], schema: T.StructType) -> list[Column]:
    """A struct per active rule: ok, rule_id, severity, message, path, actual, expected, boxes, ids."""
    out = []
    for r in rules:
        if r.get("status") and r["status"] != "active":
            continue
        if not r.get("logic"):
            raise RuleError(f"{r.get('rule_id')}: logic is missing")
        x, path = compile_logic(r["logic"], schema), first_path(r["logic"])
        boxes, ids = (x.boxes, x.ids) if x.boxes is not None else evidence(schema, path)
        out.append(F.struct(x.ok.alias("ok"), F.lit(r["rule_id"]).alias("rule_id"), F.lit(r.get("severity", "error")).alias("severity"), F.lit(r.get("message", r.get("name", ""))).alias("message"), F.lit(path).alias("path"), x.actual.alias("actual"), x.expected.alias("expected"), boxes.alias("evidence_bboxes"), ids.alias("related_ids")))
    return out


def findings(facts: DataFrame, rules: Iterable[dict], key: str = "drawing_id") -> DataFrame:
    """A row per drawing and failed rule: one projection, no shuffle but for the overlaps of boxes, which are
    a grid join. key tells the rows of facts apart."""
    facts, rules = with_overlaps(facts, rules, key)
    every = outcomes(rules, facts.schema)
    kind = "array<struct<ok:boolean,rule_id:string,severity:string,message:string,path:string,actual:string,expected:string,evidence_bboxes:string,related_ids:array<string>>>"
    failed = F.filter(F.array(*every).cast(kind) if every else F.array().cast(kind), lambda x: ~x["ok"])
    return facts.select(key, F.inline(failed)).drop("ok")


def results(facts: DataFrame, rules: list[dict], key: str = "drawing_id", rule_set_id: str = "default") -> DataFrame:
    """A row per drawing: passed (no finding of severity error), the number of findings, the set's version."""
    facts, rules = with_overlaps(facts, rules, key)
    every = outcomes(rules, facts.schema)
    oks = F.array(*[F.struct(x["ok"].alias("ok"), x["severity"].alias("severity")) for x in every]) if every else F.array().cast("array<struct<ok:boolean,severity:string>>")
    failed = F.filter(oks, lambda x: ~x["ok"])
    version = max((int(r["version"]) for r in rules if isinstance(r.get("version"), int)), default=None)
    return facts.select(key, F.lit(rule_set_id).alias("rule_set_id"), F.lit(version).cast("int").alias("rule_set_version"), (~F.exists(failed, lambda x: x["severity"] == "error")).alias("passed"), F.size(failed).alias("n_findings"))
