"""Perception: the deterministic mock backend, tile shifting, and the plug for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mock(pages: DataFrame, plan: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """An instance per page and plan entity at fractions of the page (plan: entity_id, fx1..fy2), replaced
    where an override (drawing_id, entity_id, x1..y2) is given."""
    rows = with_each(pages, plan.select("entity_id", "fx1", "fy1", "fx2", "fy2"))
    at = lambda f, side: (F.col(f) * F.col(side)).cast("int")
    out = rows.select("drawing_id", "entity_id", at("fx1", "width").alias("x1"), at("fy1", "height").alias("y1"), at("fx2", "width").alias("x2"), at("fy2", "height").alias("y2"), F.lit(0.5).alias("confidence"), F.lit(True).alias("needs_review"))
    if overrides is None:
        return out
    o = overrides.select("drawing_id", "entity_id", *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    out = out.join(o, ["drawing_id", "entity_id"], "left")
    return out.select("drawing_id", "entity_id", *[F.coalesce(f"o_{c}", c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.when(F.col("o_x1").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), (F.col("needs_review") & F.col("o_x1").isNull()).alias("needs_review"))


MOST_ENTITIES = 1000


def with_each(rows: DataFrame, config: DataFrame) -> DataFrame:
    """rows once for each row of a configuration, which is read and becomes a literal of the plan: of MOST_ENTITIES rows
    at most, as more are no configuration."""
    found = config.limit(MOST_ENTITIES + 1).collect()
    if len(found) > MOST_ENTITIES:
        raise ValueError(f"a configuration of over {MOST_ENTITIES} rows")
    kind = f"array<{config.schema.simpleString()}>"
    each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in found]).cast(kind) if found else F.array().cast(kind)
    return rows.select("*", F.inline(each))


def with_model(pages: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a model over pages in Arrow batches; load() runs once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return pages.mapInPandas(run, schema)


def shift(instances: DataFrame, dx: str, dy: str) -> DataFrame:
    """Tile coordinates as page coordinates; a missing box counts as zeros."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return instances.withColumns({"x1": z("x1") + F.col(dx), "x2": z("x2") + F.col(dx), "y1": z("y1") + F.col(dy), "y2": z("y2") + F.col(dy)})
