"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every figure is a Catalyst expression over the text column, so a filter on the verdict
stays in the scan's stage: no shuffle, no Python.

Defined results: a null or empty text has no words, all figures are 0 and it fails the
base rule. Repeated rows are judged one by one. Other columns pass through; an own column
of the name of a figure is replaced by the figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by at be this from or an are "
    "le la les de des du et un une en que qui dans pour est par sur au il elle "
    "der die das und ein eine ist nicht zu den mit von auf für im dem sich "
    "el los las una y por con se del lo como más su es"
).split()

#: (figure, least, most); None leaves a side open. A text is kept if each figure it has
#: lies within its bounds, ends included.
#: (figure, least, most, words): None leaves a side open. A text of that many words or more
#: is kept if the figure lies within its bounds, ends included.
RULES = (
    ("mean_word_chars", 1.5, 25.0, 0),
    ("symbol_ratio", None, 0.25, 0),
    ("shout_ratio", None, 0.5, 0),
    ("upper_ratio", None, 0.7, 20),
    ("stop_ratio", 0.05, None, 50),
    ("dup_line_ratio", None, 0.6, 0),
)
_EVERY_STOP = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


def repeated_words(hashes: Column) -> Column:
    """How many of a text's words lie in windows of WINDOW words found twice or more in it.

    hashes: the words' 64-bit hashes. A window is its words' combined hash. Sorting (hash,
    position) brings equal windows together, so the cost is n log n for any repetition.
    """
    n = F.size(hashes)

    def covered(win: Column) -> Column:
        keyed = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            keyed,
            lambda s: F.filter(
                F.transform(s, lambda x, j: F.when(
                    (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])), x["i"])),
                lambda p: p.isNotNull(),
            ),
        )
        total = F.aggregate(
            F.array_sort(twice),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(win)) < F.size(win), total).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        mix = lambda a, b: F.xxhash64(a, b)
        def joined(left: Column, shift: int, right: Column, back: int) -> Column:
            return F.zip_with(F.slice(left, F.lit(1), F.size(left) - back), F.slice(right, F.lit(shift + 1), F.size(right) - shift), mix)
        two = lambda x: joined(x, 1, x, 1)
        four = lambda x: joined(x, 2, x, 2)
        return let(let(let(h, two), four), lambda x: joined(x, 4, h, 0 if WINDOW == 4 else 1))

    return F.when(n > WINDOW, let(let(hashes, windows), covered)).otherwise(F.lit(0)).cast("long")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio", "shout_ratio", "upper_ratio", "stop_ratio", "dup_line_ratio")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """row (all columns of docs) and the figures: names of docs can't clash with those used on the way."""
    t = F.col("t")
    count = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    first = base.withColumns({"words": words_of(t), "lines": F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")})
    second = first.withColumns({
        "n": F.size("words"),
        "stops": F.size(F.filter("words", lambda w: w.isin(_EVERY_STOP))),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "nlines": F.size("lines"),
        "ndup": F.size("lines") - F.size(F.array_distinct("lines")),
        "chars": F.length(t) - count(r" \t\n\x0B\f\r"),
        "symbols": count("#*$%&|<>"),
        "shouts": count("!"),
        "upper": count("A-Z"),
    })
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    found = {
        "n_words": F.col("n").cast("long"),
        "word_chars": F.col("chars").cast("long"),
        "n_symbols": F.col("symbols").cast("long"),
        "n_dup_lines": F.col("ndup").cast("long"),
        "n_repeat_words": repeated_words(F.col("hashes")),
        "mean_word_chars": per("chars", "n"),
        "symbol_ratio": per("symbols", "n"),
        "shout_ratio": per("shouts", "n"),
        "upper_ratio": per("upper", "chars"),
        "stop_ratio": per("stops", "n"),
        "dup_line_ratio": per("ndup", "nlines"),
    }
    return second.select("row", *[found[x].alias(x) for x in FIGURES])


def _plain(measured: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    return measured.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each document's figures; see RULES and FIGURES."""
    return _plain(_measured(docs, text), docs, *FIGURES)


def compile_rules(rules=RULES) -> Column:
    """The table's verdict as one boolean expression; a figure that is null (no words) passes."""
    verdict = F.lit(True)
    for name, least, most, words in rules:
        x, inside = F.col(name), F.lit(True)
        if least is not None:
            inside = inside & (x >= least)
        if most is not None:
            inside = inside & (x <= most)
        verdict = verdict & ((F.col("n_words") < words) | F.coalesce(inside, F.lit(True)))
    return verdict


def _judged(docs: DataFrame, text: str, rules) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return _measured(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """figures() plus base_failed and kept."""
    return _plain(_judged(docs, text, rules), docs, *FIGURES, "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    return _judged(docs, text, rules).filter("kept").select("row.*")
