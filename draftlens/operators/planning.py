"""From a configuration to a perception plan, merging of plans with their fields, the title block's split,
table fields from text above labels.

A configuration is one small document, so its plan is built as plain dicts; plans of many drawings are
DataFrames, with fields as an array of structs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx

#: What a plan's entry has if the configuration doesn't say.
TABLE = {
    "entity_id": "info_table", "locate_query": "图纸中的表格（参数表/明细表/数据表等）", "cardinality": "many",
    "extract_all_pairs": False, "crop_expand": 0.25, "max_new_tokens": 4096,
}
MARKS = {
    "entity_id": "number_mark", "locate_query": "图中尺寸数字或数值标注（Ø直径 / R半径 / 长度 / °角度）；排除标题栏/图号/材料牌号", "cardinality": "many",
    "detect_overlap": False, "ocr_angle_adapt": False, "ocr_angle_adapt_step": 15.0, "ocr_angle_adapt_min_count": 2, "ocr_angle_adapt_max_extra": 4,
    "ocr_deskew_reread": False, "ocr_deskew_min_angle": 8.0, "exclude_table_regions": True, "exclude_table_pad": 2.0, "exclude_table_expand_up": 0.12,
}
MARK_FIELDS = (
    ("text", "尺寸标注可见原文"), ("angle", "文本相对水平线朝向角（度）"), ("dim_kind", "diameter|radius|length|angle"),
    ("basic_size", "基本尺寸"), ("tolerance", "公差"), ("has_tolerance", "是否标明公差"),
)
READ_MODES, LOCATED, MARK_BACKENDS = ("cell_content", "above_cells"), ("label", "size_position"), ("vlm", "ocr")
FIELDS = "array<struct<name:string,parse_hint:string,required:boolean,locate_by:string>>"


def _one_of(value, allowed: tuple[str, ...]) -> str:
    """The value, folded, or the first that is allowed."""
    text = str(value or "").strip().lower()
    return text if text in allowed else allowed[0]


def _filled(block: dict, defaults: dict) -> dict:
    """defaults, each replaced by the block's value as the default's type; blank texts don't replace."""
    out = {}
    for name, default in defaults.items():
        value = block.get(name)
        out[name] = default if value is None or (isinstance(default, str) and not value) else type(default)(value)
    return out


def field_list(fields) -> list[dict]:
    named = (f for f in fields or [] if isinstance(f, dict) and f.get("name"))
    return [{"name": str(f["name"]), "parse_hint": str(f.get("parse_hint") or f["name"]), "required": bool(f.get("required")), "locate_by": _one_of(f.get("locate_by"), LOCATED)} for f in named]


def table_entity(block: dict) -> dict | None:
    if not isinstance(block, dict) or not block.get("enabled", True):
        return None
    mode = _one_of(block.get("read_mode"), READ_MODES)
    out = _filled(block, TABLE) | {"fields": field_list(block.get("fields")), "parse_kind": "table", "read_mode": mode}
    out["section"] = str(block.get("section") or block.get("entity_id") or "table")
    out["value_as_array"] = bool(block.get("value_as_array", mode == "above_cells"))
    if isinstance(block.get("ocr_enhance"), dict) and block["ocr_enhance"]:
        out["ocr_enhance"] = dict(block["ocr_enhance"])
    return out


def marks_entity(block: dict) -> dict | None:
    if not isinstance(block, dict) or not block.get("enabled", False):
        return None
    fields = field_list(block.get("fields")) or field_list([{"name": n, "parse_hint": h} for n, h in MARK_FIELDS])
    return _filled(block, MARKS) | {"fields": fields, "parse_kind": "dimension_marks", "backend": _one_of(block.get("backend"), MARK_BACKENDS)}


def object_entity(block: dict) -> dict | None:
    if not isinstance(block, dict) or not block.get("enabled", True):
        return None
    if _is_marks(block):
        return marks_entity(block)
    if not block.get("entity_id"):
        return None
    own = {"entity_id": str(block["entity_id"]), "locate_query": str(block["entity_id"]), "cardinality": "one", "parse_kind": "object"}
    sizes = {name: None if block.get(name) is None else kind(block[name]) for name, kind in (("crop_expand", float), ("max_new_tokens", int))}
    return _filled(block, own) | {"fields": field_list(block.get("fields"))} | sizes


def _is_marks(block) -> bool:
    return isinstance(block, dict) and str(block.get("parse_kind") or "").lower() == "dimension_marks"


def _table_blocks(tables) -> list[dict]:
    """A list of tables, one table, or one whose sections each take over what it says."""
    if isinstance(tables, list):
        return tables
    if not isinstance(tables, dict):
        return []
    sections = [s for s in tables["sections"] if isinstance(s, dict)] if isinstance(tables.get("sections"), list) and tables["sections"] else None
    common = {k: v for k, v in tables.items() if k != "sections"}
    return [tables] if sections is None else [common | s for s in sections]


def parse_plan(config: dict | None) -> list[dict]:
    """The plan of a configuration: its objects, its tables, and the marks' old top-level block if no object has them."""
    config = config or {}
    listed = [*map(object_entity, config.get("objects") or []), *map(table_entity, _table_blocks(config.get("tables")))]
    plan = [e for e in listed if e]
    if not any(_is_marks(e) for e in plan):
        plan += [e for e in [marks_entity(config.get("dimension_marks") or {})] if e]
    return plan


def marks_config(config: dict | None) -> dict:
    """The block of dimension marks, {'enabled': False} if there is none."""
    found = [o for o in (config or {}).get("objects") or [] if _is_marks(o)]
    old = (config or {}).get("dimension_marks")
    return found[0] if found else old if isinstance(old, dict) else {"enabled": False}


def plan_rows(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """A plan as rows: seq, entity_id, locate_query, cardinality, parse_kind, backend, fields."""
    rows = [(k, e["entity_id"], e["locate_query"], e["cardinality"], e["parse_kind"], e.get("backend"), [(f["name"], f["parse_hint"], f["required"], f["locate_by"]) for f in e["fields"]]) for k, e in enumerate(plan)]
    return spark.createDataFrame(rows, f"seq int, entity_id string, locate_query string, cardinality string, parse_kind string, backend string, fields {FIELDS}")


def merge_fields(entries: DataFrame) -> DataFrame:
    """entity_id, locate_query, fields of plans' entries (with seq and fields): fields once by name, in the order they
    are first met, with the last hint and way to locate that aren't blank, required if any entry says so."""
    keys = ["entity_id", "locate_query"]
    each = entries.filter("entity_id is not null").select(F.col("entity_id"), F.coalesce("locate_query", F.lit("")).alias("locate_query"), "seq", F.posexplode("fields").alias("pos", "f"))
    at = F.struct("seq", "pos")
    last = lambda c: F.max_by(F.col(f"f.{c}"), F.when(F.coalesce(F.col(f"f.{c}"), F.lit("")) != "", at))
    per = each.groupBy(*keys, F.col("f.name").alias("name")).agg(F.min(at).alias("first"), last("parse_hint").alias("hint"), F.bool_or(F.coalesce("f.required", F.lit(False))).alias("required"), last("locate_by").alias("locate"))
    field = F.struct("name", F.coalesce("hint", "name").alias("parse_hint"), "required", F.coalesce("locate", F.lit(LOCATED[0])).alias("locate_by"))
    listed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", field.alias("field")))).alias("l"))
    return listed.select(*keys, F.transform("l", lambda x: x["field"]).alias("fields"))


#: The row that parts the material table from the main one.
PRODUCT, LONGEST_PRODUCT = r"(?i)\bproduct\b", 48


def title_split(seeds: DataFrame, items: DataFrame, width: int, height: int, pad: int = 12, search_up: int = 40) -> DataFrame:
    """(drawing_id, product_y, m_* and n_* boxes): the title block parted at its lowest row that says product. seeds:
    drawing_id and boxes of the block; items: drawing_id, iid, text and box of texts on the page. The main table
    starts at that row, the material table above it, from the block's own top. Drawings without such a row have none."""
    whole = seeds.filter("x2 > x1 and y2 > y1").groupBy("drawing_id").agg(F.min("x1").alias("sx1"), F.min("y1").alias("sy1"), F.max("x2").alias("sx2"), F.max("y2").alias("sy2"))
    area = g.Box(F.greatest(F.lit(0), F.col("sx1") - pad), F.greatest(F.lit(0), F.col("sy1") - max(pad, search_up)), F.least(F.lit(width), F.col("sx2") + pad), F.least(F.lit(height), F.col("sy2") + pad))
    own = g.Box("x1", "y1", "x2", "y2")
    text = tx.stripped(F.col("text"))
    rows = items.filter(text.rlike(PRODUCT) & (F.length(text) <= LONGEST_PRODUCT)).join(whole, "drawing_id").filter(g.inside(own.cx, own.cy, area))
    found = rows.groupBy("drawing_id", "sx1", "sy1", "sx2", "sy2").agg(F.max("y1").alias("product_y"))
    top = F.least(F.greatest(F.lit(0), F.col("sy1") - pad), F.greatest(F.lit(0), F.col("product_y") - 4))
    return found.select(
        "drawing_id", "product_y", area.x1.alias("m_x1"), top.alias("m_y1"), area.x2.alias("m_x2"), F.greatest(top + 4, F.col("product_y")).alias("m_y2"),
        area.x1.alias("n_x1"), F.col("product_y").alias("n_y1"), area.x2.alias("n_x2"), area.y2.alias("n_y2"),
    )


#: A label fits from this score on.
FITS = 0.8


def fields_above_labels(items: DataFrame, fields: DataFrame, most_gap: int = 100, least_overlap: float = 0.25) -> DataFrame:
    """(table_id, seq, name, label, values): table fields from the texts that stand above their labels. items: table_id,
    iid, text, box; fields: table_id, seq, name, aliases (normalised). Fields in order each take the free text that fits
    best, the lowest of equals, as their label. A text that is no label, and fits none of the table's aliases, goes to the
    nearest label below it in its column; a field's values are ordered by their tops. Null: no label, or nothing above.

    One table is one group, bounded by a page: choosing labels one after the other needs them together."""
    from ..ship import ship
    from .fuzzy import label_score

    ship(items.sparkSession)
    normal = items.select("table_id", "iid", tx.stripped(F.col("text")).alias("text"), tx.normal_label(F.col("text")).alias("label"), "x1", "y1", "x2", "y2").filter("text <> ''")

    def run(key, cells: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        cells, wanted = cells.sort_values("iid").to_dict("records"), wanted.sort_values("seq").to_dict("records")
        fit = lambda c, names: max((label_score(c["label"], a) for a in names), default=0.0)
        labels: dict[str, dict] = {}
        for f in wanted:
            free = [(fit(c, f["aliases"]), c["y1"], -k, c) for k, c in enumerate(cells) if all(c is not x for x in labels.values())]
            best = max((x for x in free if x[0] >= FITS), default=None, key=lambda x: x[:3])
            if best:
                labels[f["name"]] = best[3]
        every = [a for f in wanted for a in f["aliases"]]
        values: dict[str, list] = {}
        for c in cells:
            if any(c is x for x in labels.values()) or fit(c, every) >= FITS:
                continue
            below = [(x["y1"] - c["y2"], k, name) for k, (name, x) in enumerate(labels.items()) if 0 <= x["y1"] - c["y2"] <= most_gap and _shared(x, c) >= least_overlap]
            if below:
                values.setdefault(min(below)[2], []).append((c["y1"], c["iid"], c["text"]))
        rows = [(key[0], f["seq"], f["name"], labels[f["name"]]["text"] if f["name"] in labels else None, [t for _, _, t in sorted(values[f["name"]])] if f["name"] in values else None) for f in wanted]
        return pd.DataFrame(rows, columns=["table_id", "seq", "name", "label", "values"])

    kind = fields.schema["table_id"].dataType.simpleString()
    return normal.groupBy("table_id").cogroup(fields.groupBy("table_id")).applyInPandas(lambda key, a, b: run(key, a, b), f"table_id {kind}, seq int, name string, label string, values array<string>")


def _shared(a: dict, b: dict) -> float:
    """The common width's share of the smaller width."""
    common = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
    return max(0, common) / max(1, min(a["x2"] - a["x1"], b["x2"] - b["x1"]))


def as_list(value: Column) -> Column:
    """An array<string> without null and blank entries, ends stripped; null if none is left."""
    kept = F.filter(F.transform(value, tx.stripped), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def as_scalar(value: Column) -> Column:
    """The same as one text: the only entry itself, several as a JSON array, null if none."""
    kept = as_list(value)
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0))).when(kept.isNotNull(), F.to_json(kept))
