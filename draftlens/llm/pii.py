"""Personal data: base patterns plus a character BiLSTM-CRF that adds spans.

Kinds: email, ip, card, phone. The base patterns and the tagger both run over the whole text. The
tagger reads windows of WINDOW characters that overlap; each is decoded with the CRF transitions. The windows'
spans are then reconciled over the whole text: of spans that overlap, those cut by a window's end are united
with their other part, and else the one nearest to the middle of its window stands. A window is left out only
where it can change no result: it and its neighbours have nothing that a kind's own condition asks for.
A decoded span is added if it meets its kind's own condition (digits, checksum, parts) and overlaps no
base span; base spans stay.

The tagger is trained in numpy from labelled spans that a seeded generator writes: the kinds in written
variants (spaces or brackets about the @ and dots, at and dot spelled out, phone numbers without a plus, ...),
among made-up words and look-alikes that are none (hex keys, key ids, versions, dates, prices, at and dot in prose).

Memory: windows are read GROUP characters at a time, whatever the length of the texts.

Defined results: null and empty texts have no spans; spans are code points, end exclusive,
ordered by start, then by kind as listed; repeated rows are searched one by one; other columns
pass through, but for `spans`, which is replaced.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..ship import ship
from .common import trimmed
from .tagger import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP, TRAINED = 128, 96, 64
GROUP = 1 << 18
BATCH, STEPS = 64, 500

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run has no match from its middle that it hasn't from its start, so it is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _TRIGGER.search(text):
        only = lambda s: "".join(c for c in s if "0" <= c <= "9")
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_small(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = only(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(only(m[0])) <= 15]
    return sorted(out)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


# An @ may have spaces or brackets about it, and so may its dots; where at is spelled out, dots are
# spelled out or in brackets too, or stand close, so that a sentence's end is none.
_LEFT, _RIGHT = r"(?:\s*[\[({<]\s*|\s+)", r"(?:\s*[\])}>]\s*|\s+)"
_SIGN, _AT, _SPELLED = r"\s*[\[({<]?\s*@\s*[\])}>]?\s*", rf"{_LEFT}(?:at|AT){_RIGHT}", rf"(?:{_LEFT}(?:dot|DOT){_RIGHT}|\s*[\[({{<]\s*\.\s*[\])}}>]\s*|\.)"
_DOT = rf"(?:{_SPELLED}|\s*\.\s*)"
_EMAIL = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+){{0,3}}{_SIGN}[\w-]+(?:{_DOT}[\w-]+){{1,4}}|[\w%+-]+(?:{_SPELLED}[\w%+-]+){{0,3}}{_AT}[\w-]+(?:{_SPELLED}[\w-]+){{1,4}}")
#: Every span that can be plausible has one of these in it.
_NEEDED = re.compile(rf"[0-9@]|{_AT}[\w-]+{_SPELLED}")
MOST_SPAN = 120


def plausible(kind: int, s: str) -> bool:
    """Whether a decoded span's text can be of its kind."""
    d = "".join(c for c in s if "0" <= c <= "9")
    if kind == 0:
        return len(s) <= MOST_SPAN and bool(_EMAIL.fullmatch(s))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(_small(x) for x in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s)


def _made(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up line with labelled spans."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    letters = lambda n, of="aeiourstnlhdmcéüñgp": "".join(of[int(i)] for i in rng.integers(0, len(of), n))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: letters(int(rng.integers(1, 11)))

    def card() -> str:
        d = pick("4", "5", "37", "6") + digits(13)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", "", " ", "-", ".", "/")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("[@]", "."), ("(@)", "."), (" @ ", " . "), ("@", "[.]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "), ("(at)", "[dot]"), (" AT ", " DOT "))
        host = [letters(int(rng.integers(3, 9)), "abcdeilmnost"), *([pick("example", "mail", letters(5))] if rng.integers(2) else []), pick("com", "org", "net", "de", "co", "fr", "es", "io")]
        return letters(int(rng.integers(3, 9)), "abcdefghiklmnoprstu") + pick("", "", "." + digits(2), "_" + letters(4), dot + letters(6)) + at + dot.join(host)

    def ip() -> str:
        return pick(".", ".", "[.]", "(.)", " . ", "-").join(str(int(rng.integers(1, 255))) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}", f"+{digits(2)} {a} {b}{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}")

    def other() -> str:
        hexes = lambda n: letters(n, "0123456789abcdef")
        return pick(f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"${digits(3)}.{digits(2)}", digits(int(rng.integers(1, 8))), digits(20), f"@{word()}", f"{digits(2)}:{digits(2)}", f"sha256:{hexes(32)}", f"{word()} at {word()} dot", f"at {word()} dot {word()}", f"{word()}. {word()} at {word()}", f"(dot) [at] {word()}", f"{digits(1)},{digits(3)},{digits(3)}")

    text, spans = "", []
    while len(text) < TRAINED + 40:
        kind = int(rng.integers(0, 14))
        if kind < 4:
            s = (email, ip, card, phone)[kind]()
            spans.append((len(text), kind, len(text) + len(s)))
        elif kind < 7:
            s = other()
        else:
            s = " ".join(word() for _ in range(int(rng.integers(1, 5))))
            s = s.capitalize() if rng.integers(3) == 0 else s
        text += s + pick(" ", " ", " ", ". ", ", ", "\n")
    return text, spans


def made_batch(rng: np.random.Generator, n: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Windows (time, batch) of made-up lines and their tags: 0, or 1 + kind inside a span."""
    xs, ys = [], []
    while len(xs) < n:
        text, spans = _made(rng)
        y = np.zeros(len(text), np.int64)
        for a, k, b in spans:
            y[a:b] = 1 + k
        lo = int(rng.integers(0, 40))
        xs.append(classes(text)[lo : lo + TRAINED])
        ys.append(y[lo : lo + TRAINED])
    return np.array(xs).T, np.array(ys).T


@functools.lru_cache(maxsize=4)
def fit(steps: int = STEPS, seed: int = 11) -> Tagger:
    rng = np.random.default_rng(seed)
    tagger = Tagger(1 + len(KINDS))
    tagger.train(made_batch(rng) for _ in range(steps))
    return tagger


def needed(text: str, every: bool = False) -> np.ndarray:
    """The numbers of the windows that can give a span: plausible() asks each kind for something of _NEEDED, so a
    window without any, itself and in the two beside it, gives none. every: all windows."""
    n = max(0, -(-(len(text) - WINDOW) // STEP)) + 1 if text else 0
    if every:
        return np.arange(n)
    at = np.array([x for m in _NEEDED.finditer(text) for x in (m.start(), m.end() - 1)], np.int64)
    wanted = np.zeros(n, bool)
    if len(at):
        first, last = np.maximum(0, (at - WINDOW) // STEP + 1) - 1, at // STEP + 1
        for d in range(int((last - first).max()) + 1):
            wanted[np.clip(np.minimum(first + d, last), 0, n - 1)] = True
    return np.flatnonzero(wanted)


def windows(texts: list[str], every: bool = False):
    """(classes (window, character), text of each, where it starts) in runs of about GROUP characters;
    a text's windows start at multiples of STEP, the last one is filled up with spaces."""
    held, size = [], 0

    def out():
        return np.concatenate([h[0] for h in held]), np.concatenate([np.full(len(h[0]), h[1]) for h in held]), np.concatenate([h[2] for h in held])

    blank, per = classes(" ")[0], GROUP // WINDOW
    for k, t in enumerate(texts):
        mine = needed(t, every)
        for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if len(mine) else []:
            for lo in range(0, len(run), per):
                start = run[lo : lo + per] * STEP
                x = np.full((len(start) - 1) * STEP + WINDOW, blank)
                part = classes(t[int(start[0]) : int(start[0]) + len(x)])
                x[: len(part)] = part
                held.append((np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STEP], k, start))
                size += len(start) * WINDOW
                if size >= GROUP:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def decoded(tagger: Tagger, texts: list[str], every: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) per text, reconciled over its windows; those that can give no span are left out."""
    found: list[list[tuple]] = [[] for _ in texts]
    for x, text, start in windows(texts, every):
        for lo in range(0, len(x), 512):
            tags = tagger.best(tagger.scores(np.ascontiguousarray(x[lo : lo + 512].T)))
            for w in np.flatnonzero(tags.any(0)).tolist():
                k, at, mine = int(text[lo + w]), int(start[lo + w]), tags[:, w]
                edge = np.flatnonzero(np.diff(mine, prepend=0, append=0))
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    a, b = at + i, min(at + j, len(texts[k]))
                    if mine[i] and b > a:
                        cut = (i == 0 and at > 0) or (j == WINDOW and at + WINDOW < len(texts[k]))
                        found[k].append((a, int(mine[i]) - 1, b, cut, abs(i + j - WINDOW)))
    return [reconciled(f) for f in found]


def reconciled(found: list[tuple]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of a text's windows (start, kind, end, cut by the window's end,
    distance from its middle)."""
    out: list[tuple] = []
    for span in sorted(found):
        if not out or span[0] >= out[-1][2]:
            out.append(span)
            continue
        last = out[-1]
        if last[1] == span[1] and (last[3] or span[3]):
            out[-1] = (last[0], last[1], max(last[2], span[2]), last[3] and span[3], min(last[4], span[4]))
        elif (span[3], span[4]) < (last[3], last[4]):
            out[-1] = span
    return [s[:3] for s in out]


def find(tagger: Tagger, texts: list[str | None], every: bool = False) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. every: no window is left out."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    out = []
    for t, own, more in zip(texts, base, decoded(tagger, texts, every), strict=True):
        all_ = list(own)
        for a, k, b in more:
            while b > a and t[b - 1] in " .,;:\n\t":
                b -= 1
            while a < b and t[a] in " ,;:\n\t":
                a += 1
            if b > a and plausible(k, t[a:b]) and not any(x < b and a < y for x, _, y in all_):
                all_.append((a, k, b))
        out.append((own, sorted(all_)))
    return out


SPANS = "spans array<struct<kind:string,start:long,stop:long,base:boolean>>"


def tag(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """docs with their spans; base: by the patterns."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*[c for c in ("spans",) if c in docs.columns])
    held = spark.sparkContext.broadcast(tagger)
    at, names = docs.columns.index(text), docs.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [[{"kind": KINDS[k], "start": x, "stop": y, "base": (x, k, y) in own} for x, k, y in every] for own, every in find(held.value, part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=[*names, "spans"])

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, *StructType.fromDDL(SPANS).fields]))


def masked(found: DataFrame, text: str = "text") -> DataFrame:
    """Texts with each span's characters replaced by its kind in brackets; overlapping spans as one."""
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["stop"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.col(text).substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return found.withColumn(text, merged)
