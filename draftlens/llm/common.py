"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
BROADCAST_ROWS = 1_000_000

_own_dirs: dict[str, str] = {}
_held: dict[tuple[str, str], object] = {}
_ARROW = {StringType: pa.string(), IntegerType: pa.int32(), LongType: pa.int64(), DoubleType: pa.float64()}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local run gets a
    folder of its own; a cluster has none that all machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="draftlens-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it and never recompute df.
    forget() removes it after its last reader has run."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame) -> bool:
    """Whether a table is small enough for a broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if few(df) else df


def few_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of rows that the driver has. Columns of plain kinds go there as Arrow: others pass through Python
    workers of a pool of their own, which stay beside those of later stages."""
    schema = StructType.fromDDL(ddl)
    kinds = [_ARROW.get(type(f.dataType)) for f in schema.fields]
    if not rows or None in kinds:
        return spark.createDataFrame(rows, schema)
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def kept(operator: str, key: str, make):
    """make(), kept in this worker for the operator's later tasks."""
    if (operator, key) not in _held:
        _held[operator, key] = make()
    return _held[operator, key]


def let_go(operator: str | None) -> None:
    """Drops what this worker keeps for other operators."""
    others = [k for k in _held if k[0] != operator]
    for k in others:
        del _held[k]
    if others:
        trim()


def trimmed(run, operator: str | None = None):
    """run, an Arrow batch function, that hands memory it has freed back to the system when it ends: workers
    are used again, and what they keep would add to the next stage's. So what they keep for another operator goes first."""

    def outer(batches):
        let_go(operator)
        try:
            yield from run(batches)
        finally:
            trim()

    return outer


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs inside hand workers batches of so many rows at most, so that long texts don't add up."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, [^\\x20\\x09-\\x0D]+; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
