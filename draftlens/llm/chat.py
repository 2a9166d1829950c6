"""Chat formatting with Spark expressions only.

A conversation becomes one string: its turns are collected as structs and sorted, adjacent turns of one
role are merged by array functions to a block, and blocks are concatenated:

    <s>ROLE<m>TEXT<t>TEXT</s>

<s> opens a block, <m> ends its role, <t> parts the texts of merged turns, </s> closes it.
Inside roles and texts a backslash follows each of `<`, `[` and backslash, so that no control
string (these, or [INST] and the like) can appear there; taking that backslash away again
gives the text back exactly. loss_spans has the code-point range of each assistant text, its
escapes included and nothing else.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and repeated
rows have one order; a null text or role is empty; a null conv_id is a conversation of its own;
an empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, MIDDLE, NEXT, CLOSE = "<s>", "<m>", "<t>", "</s>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


CHUNK = 64  # of the running sums


def running(lengths: Column) -> Column:
    """The running sums of an array: by sums of chunks, so that long arrays cost little more than their length."""
    whole = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / CHUNK).cast("int")), lambda c: whole(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    return let(chunks, lambda sums: F.transform(lengths, lambda x, i: whole(F.slice(sums, F.lit(1), F.floor(i / CHUNK).cast("int"))) + whole(F.slice(lengths, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), (i % CHUNK + 1).cast("int")))))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,stop>>.

    One shuffle by conversation collects its turns; sorting, merging and offsets are array functions
    over them. A conversation is gathered whole, as its one output string has to be.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    role_at = lambda i: F.get("turns", i)["role"]
    opens = lambda i: (i == 0) | (role_at(i) != role_at(i - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), opens)
    found = sorted_.withColumn("starts", starts)
    merged = F.transform("starts", lambda s, k: F.struct(role_at(s).alias("role"), F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: t["text"]).alias("texts")))
    block = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(MIDDLE), F.array_join(b["texts"], NEXT), F.lit(CLOSE))
    opening = lambda t: len(OPEN) + len(MIDDLE) + F.length(t["role"])
    lead = lambda t, i: F.when(i == 0, opening(t)).when(opens(i), len(CLOSE) + opening(t)).otherwise(len(NEXT))
    stops = running(F.transform("turns", lambda t, i: (lead(t, i) + F.length(t["text"])).cast("long")))
    spans = F.transform("turns", lambda t, i: F.struct((F.get("stops", i) - F.length(t["text"])).alias("start"), F.get("stops", i).alias("stop"), t["role"].alias("role")))
    out = found.withColumns({"blocks": merged, "stops": stops})
    learned = F.transform(F.filter(spans, lambda s: s["role"] == LEARNED), lambda s: F.struct(s["start"], s["stop"]))
    return out.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), learned.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(OPEN) + 1, 2**31 - 1), MIDDLE)
        return F.transform(F.split(F.get(parts, F.lit(1)), NEXT), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
