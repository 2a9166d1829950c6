"""Benchmark decontamination: one Aho-Corasick automaton over the test items' windows.

Items are normalised to words (ASCII lower-cased; every other ASCII character than a letter or
digit separates; characters beyond ASCII belong to words). Each run of `window` words, or a
shorter item as a whole, becomes one pattern, with a space on both sides so that it matches
whole words only. A text is normalised the same way and scanned once; hits come back as word
ranges and as code-point offsets of the original text.

The automaton lives in each Python worker. Patterns are packed in groups of at most
MAX_AUTOMATON characters, so its memory is bounded: a benchmark beyond that is scanned in
several passes, each with an automaton of its own, and the hits of a document are united. Items reach
the driver partition by partition, and it holds one group at a time; each group is a broadcast of bounded size.

Defined results: null or empty texts have no words and no hits; items without words are never
found; a null item id is an item of its own, the empty string among item ids; repeated items are found
together; repeated documents are scanned one by one; an empty benchmark leaves every document clean. Ids of
any type are given as strings.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..ship import ship
from .common import trimmed

WINDOW = 10
MAX_AUTOMATON = 16_000_000  # pattern characters in one automaton

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "n_words long, hits array<struct<item_id:string,first:long,last:long,start:long,stop:long>>"


def fold(text: str | None) -> list[bytes]:
    """The normalised words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def patterns(items: Iterator[tuple[str, str | None]], window: int = WINDOW) -> Iterator[tuple[str, int, str]]:
    """(pattern, its words, item) for each window of each item."""
    for item, text in items:
        words = fold(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            yield f" {b' '.join(part).decode()} ", len(part), item


def groups(items: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[list[tuple[str, int, str]]]:
    """The patterns in groups of bounded size; rows come to the driver one partition at a time."""
    held, chars = [], 0
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator()
    for x in patterns(((r[0], r[1]) for r in rows), window):
        if held and chars + len(x[0]) > MAX_AUTOMATON:
            yield held
            held, chars = [], 0
        held.append(x)
        chars += len(x[0])
    yield held


_built: dict[str, object] = {}


def automaton(found: list[tuple[str, int, str]]):
    import ahocorasick

    by: dict[str, tuple[int, set[str]]] = {}
    for pattern, n, item in found:
        by.setdefault(pattern, (n, set()))[1].add(item)
    a = ahocorasick.Automaton()
    for pattern, (n, ids) in by.items():
        a.add_word(pattern, (n, sorted(ids)))
    if by:
        a.make_automaton()
    return a if by else None


def scan(a, text: str | None) -> tuple[int, list[dict]]:
    """The words of a text and its hits: item, first and last word, code points of the original (stop exclusive)."""
    words = fold(text)
    if a is None or not words:
        return len(words), []
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = list(a.iter(line))
    if not found:
        return len(words), []
    spaces = [i for i, c in enumerate(line) if c == " "]
    spans = [m.span() for m in _WORDS.finditer(text)]
    hits = set()
    for end, (n, ids) in found:
        last = bisect.bisect_left(spaces, end) - 1
        hits.update((i, last - n + 1, last) for i in ids)
    return len(words), [{"item_id": i, "first": x, "last": y, "start": spans[x][0], "stop": spans[y][1]} for i, x, y in sorted(hits)]


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words and hits; columns of these names are replaced."""
    ship(docs.sparkSession)
    out = docs.drop(*[c for c in ("n_words", "hits") if c in docs.columns])
    parts = [docs.sparkSession.sparkContext.broadcast(g) for g in groups(items, item_id, item_text, window)]
    for k, part in enumerate(parts):
        out = _pass(out, part, text, first=k == 0)
    return out


def _pass(docs: DataFrame, part, text: str, first: bool) -> DataFrame:
    names = [c for c in docs.columns if c not in ("n_words", "hits")]
    schema = StructType([*(f for f in docs.schema.fields if f.name in names), *StructType.fromDDL(RESULT).fields])
    at, key = names.index(text), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.string()), *((x, pa.int64()) for x in ("first", "last", "start", "stop"))]))

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = automaton(part.value)
        a = _built[key]
        for b in batches:
            got = [scan(a, x) for x in b.column(at).to_pylist()]
            hits = [x for _, x in got]
            if not first:
                hits = [[*old, *new] for old, new in zip(b.column(len(names) + 1).to_pylist(), hits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(names))], pa.array([n for n, _ in got], pa.int64()), pa.array(hits, kind)],
                names=[*names, "n_words", "hits"],
            )

    return docs.mapInArrow(trimmed(run), schema)


def verdicts(found: DataFrame) -> DataFrame:
    """found() with n_hit (words inside any hit), item_ids (distinct) and contaminated."""
    marks = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["first"].alias("a"), h["last"].alias("b")))))
    covered = F.aggregate(
        marks,
        F.struct(F.lit(-1).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"] - 1, s["to"]))).alias("n")),
        lambda s: s["n"],
    )
    return found.withColumns({"n_hit": covered, "item_ids": F.array_distinct(F.transform("hits", lambda h: h["item_id"]))}).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("scanned"))
    return find(row, items, "scanned").filter(F.size("hits") == 0).select("row.*")
