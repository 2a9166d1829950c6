"""Sources and sinks: rule libraries, gold sets, page images, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def stem(path):
    """The file name without its suffix: a drawing's id."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def load_rules(spark: SparkSession, folder: str, only_active: bool = True, rule_ids: list[str] | None = None) -> list[dict]:
    """The rules of a folder's *.json files, by file name; a missing folder has none. Rule sets are small
    configuration; they are read through Spark, so any store serves."""
    try:
        rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.input_file_name().alias("path"), "value").orderBy("path").collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    rules = [json.loads(r["value"]) for r in rows]
    return [r for r in rules if (not only_active or r.get("status") == "active") and (not rule_ids or r.get("rule_id") in rule_ids)]


def load_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON documents, one per file."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema is not None else reader.option("singleVariantColumn", "value").json(path)


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """(drawing_id, path, length, modificationTime) of a folder's images; contents aren't read unless selected."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(suffixes))).withColumn("drawing_id", stem(F.col("path")))


def ingest_signature(max_side: int = 2048, dpi: int = 200, page: int = 1):
    """What must agree for a page to be taken as it is: over columns of files()."""
    return F.concat_ws("|", "path", "length", F.unix_seconds("modificationTime").cast("string"), F.lit(max_side), F.lit(dpi), F.lit(page))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """drawing_id, width, height, channels and BGR data of decoded images."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(stem(F.col("image.origin")).alias("drawing_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_summary(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def options(cli: dict, config: dict, defaults: dict) -> dict:
    """Run options: what the command line gives, else the configuration, else the default."""
    out = {k: next((s[k] for s in (cli, config, defaults) if s.get(k) is not None), None) for k in {*cli, *config, *defaults}}
    if isinstance(out.get("rule_ids"), str):
        out["rule_ids"] = [out["rule_ids"]]
    if not out.get("drawing") and not out.get("allow_missing"):
        raise ValueError("no drawing is given")
    return out


def load_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
