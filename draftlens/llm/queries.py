"""The opN_ queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_text, lm_score, mixing, ngram_join, pii, quality, token_store, toxicity
from .common import table

SQL_SPACES = r"[ \t\n\x0B\f\r]+"


def sha(x):
    return F.sha2(x.cast("binary"), 256)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql() -> str:
    parts = []
    for name, least, most, words in quality.RULES:
        inside = " and ".join([*([f"{name} >= {least}"] if least is not None else []), *([f"{name} <= {most}"] if most is not None else [])])
        parts.append(f"(n_words < {words} or coalesce({inside}, true))")
    return " and ".join(parts)


def quality_sql(docs: str, columns: str) -> str:
    """DuckDB text of the quality rules over a relation with doc_id and text."""
    stops = ", ".join(f"'{w}'" for w in sorted({f for w in quality.STOP_WORDS for f in (w, w.capitalize(), w.upper())}))
    return rf"""
with quality_rows as (select *, row_number() over () as rid, coalesce(text, '') as t from {docs}),
quality_words as (select *, list_filter(regexp_split_to_array(t, '{SQL_SPACES}'), lambda w: w <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) as ls from quality_rows),
quality_windows as (select rid, i, array_to_string(ws[i:i+4], ' ') as k
  from (select rid, ws, unnest(generate_series(1, len(ws) - 4)) as i from quality_words)),
quality_twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from quality_windows) where n > 1),
quality_repeats as (select rid, sum(least(5, i - before)) as n from
  (select rid, i, coalesce(lag(i) over (partition by rid order by i), -10) as before from quality_twice) group by rid),
quality_figures as (select w.*, len(ws) as n_words, len(ls) as nlines,
  length(t) - (length(t) - length(regexp_replace(t, '{SQL_SPACES[:-1]}', '', 'g'))) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  length(t) - length(regexp_replace(t, '[!]', '', 'g')) as n_shouts,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
  len(list_filter(ws, lambda w: w in ({stops}))) as n_stops,
  len(ls) - len(list_distinct(ls)) as n_dup_lines,
  cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from quality_words w left join quality_repeats r using (rid)),
quality_ratios as (select *, word_chars / nullif(n_words, 0) as mean_word_chars, n_symbols / nullif(n_words, 0) as symbol_ratio,
  n_shouts / nullif(n_words, 0) as shout_ratio, n_upper / nullif(word_chars, 0) as upper_ratio,
  n_stops / nullif(n_words, 0) as stop_ratio, n_dup_lines / nullif(nlines, 0) as dup_line_ratio,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from quality_figures)
select {columns}, not base_failed and {_rules_sql()} as kept from quality_ratios"""


OP3_SQL = quality_sql("documents", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.score(docs, fold("doc_id", 7) != 2)
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.read(spark, manifest)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.tag(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.fit())
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(pii.KINDS) for x in (kind, k)])
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["stop"], s["kind"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, sha(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.verdicts(decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    ids = F.array_sort("item_ids")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha(F.array_join(ids, ",")).alias("items_sha256"), "contaminated")


_FOLD_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP8_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, {_FOLD_SQL} as ws from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id, {_FOLD_SQL} as ws from benchmark),
bw as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as k
  from (select item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) as i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(ws[i:i + n - 1], ' ') as k
  from (select rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from d, sizes)),
hits as (select rid, i, bw.n, item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as p from hits) group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rid) left join items using (rid)"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), F.col("shards").cast("string").alias("shards"))


def planted_chats(turns: DataFrame) -> DataFrame:
    """turns plus conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_chats(planted_chats(table(spark, sf_dir, "conversations")))
    back = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) as rl, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) as tl,
  lag(role) over (partition by conv_id order by turn nulls first, role, text) as before from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(tl + case when before is null then 6 + rl when before = role then 3 else 10 + rl end) + 4 as bigint) as formatted_chars
from e group by conv_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_score": op4_lm_score,
    "op5_html_text": op5_html_text,
    "op6_token_store": op6_token_store,
    "op7_pii": op7_pii,
    "op8_decontam": op8_decontam,
    "op9_mixing": op9_mixing,
    "op10_chat_format": op10_chat_format,
}
SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op8_decontam": OP8_SQL, "op10_chat_format": OP10_SQL}
