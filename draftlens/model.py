"""The drawing model's schemas and its projection on the test tables.

A drawing is a page of instances (boxes with text), its facts are nested arrays by kind, and
rules speak about facts. Order is data: every list carries `seq` or an id that gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entity id to (facts key, whether the key holds a list).
ENTITY_KEYS = {
    "title_block": ("title_block", False), "component": ("components", True), "components": ("components", True),
    "feature": ("features", True), "features": ("features", True), "annotation": ("annotations", True), "annotations": ("annotations", True),
    "number_mark": ("annotations", True), "dimension_marks": ("annotations", True), "datum": ("datums", True), "datums": ("datums", True),
    "info_table": ("tables", True), "main_table": ("tables", True),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One page per user, one box per event; integer arithmetic, so that any engine agrees.
INSTANCES = """
select user_id as drawing_id, event_id as iid, event_type as entity_id, x1, y1,
  x1 + case when event_id % 3 = 0 then h else w end as x2, y1 + case when event_id % 3 = 0 then w else h end as y2,
  cast((event_id * 7919) % 10007 as int) as conf, event_id % 2 = 1 as keep_pair,
  case event_id % 6 when 0 then concat('Ø', v, '±0.', cast(event_id % 10 as string)) when 1 then concat('R', cast(event_id % 97 as string))
    when 2 then concat(cast(event_id % 180 as string), '°±1') when 3 then concat(cast(event_id % 50 as string), ',5 + / - 0.2') when 4 then 'note' else v end as txt
from (select *, cast((event_id * 37) % 900 as int) as x1, cast((event_id * 91) % 700 as int) as y1,
  cast(10 + event_id % 60 as int) as w, cast(8 + event_id % 30 as int) as h, cast(cast(value as decimal(10,2)) as string) as v from {events})
"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INSTANCES.format(events="{events}"), events=table(spark, sf_dir, "events"))


TITLES = """
select o_orderkey as drawing_id, case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then '  ' else concat('A-', cast(o_orderkey as string)) end as part_no,
  o_orderpriority as material, c_mktsegment as name, cast(o_orderkey % 5 as int) as sheet, concat('R', cast(o_orderkey % 4 as string)) as ref
from {orders} join {customer} on o_custkey = c_custkey
"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title block per order."""
    return spark.sql(TITLES, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


COMPONENTS = """
select drawing_id, seq, concat('R', cast(seq as string)) as id, case when qty > 45 then '' else cast(qty as string) end as value, x1, y1, x1 + 20 as x2, y1 + 12 as y2
from (select l_orderkey as drawing_id, cast(l_quantity as int) as qty, cast((l_partkey * 37) % 900 as int) as x1, cast((l_suppkey * 91) % 700 as int) as y1,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as int) as seq from {lineitem})
"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMPONENTS, lineitem=table(spark, sf_dir, "lineitem"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id, title_block, components: a drawing per order."""
    box = F.struct("x1", "y1", "x2", "y2").alias("bbox")
    parts = components(spark, sf_dir).groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "value", box))).alias("components"))
    title = F.struct("part_no", "material", "name", "sheet", "ref", F.struct(F.lit(10).alias("x1"), F.lit(10).alias("y1"), F.lit(50).alias("x2"), F.lit(40).alias("y2")).alias("bbox")).alias("title_block")
    return titles(spark, sf_dir).select("drawing_id", title).join(parts, "drawing_id", "left").withColumn("components", F.coalesce("components", F.array().cast(parts.schema["components"].dataType)))
