"""Toxicity: a subsequence string-kernel SVM with Nystrom landmarks.

The kernel counts common subsequences of three characters of two words, gaps allowed within a
span of SPAN characters, each weighed by DECAY to the length it spans, and is normalised. Thus
a word with inserted or gapped characters stays near its plain form. Landmarks are word forms
of the labelled sample; words are mapped to kernel values against them times the inverse root
of the landmarks' own kernel matrix, and a squared-hinge linear SVM is fitted there. As kernel
and map are linear in a word's subsequence weights, the fitted model folds into one table of
weights by subsequence, which scores a word in time linear in its length.

Labels belong to whole texts, so words are labelled by the usual multiple-instance step: words
whose rate in toxic texts is far above that in others count as toxic, with perturbed copies
(a character inserted between any two); words of other texts do not; the clean words scored
highest come in again as negatives. A logistic layer on a text's highest word scores and the
number of words on the toxic side gives the text's probability. Runs of one-letter words are
joined to one word, so spaced-out insults are seen.

The fit uses at most SAMPLE_TOXIC and SAMPLE_OTHER labelled training rows, those first by a
hash of the id, whole; of their word forms, which grow with the sample alone, it takes the numbers above. Longer words
than CHUNK characters are scored by overlapping pieces, and don't count as toxic in the fit, where they are
mostly junk. Every text is scored whole. Only the text enters a score.

What is learned is a word's toxicity: an insult that is only one as several words together isn't found.

Defined results: null and empty texts have no words and get the score of a text without any;
without toxic or without other labels the score is the share of toxic ones (0 without labels);
labels that disagree on a doc_id count as toxic; null labels are left out; repeated rows score
alike; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import trimmed

SAMPLE_TOXIC, SAMPLE_OTHER = 2500, 5000
MOST_POSITIVE, MOST_PERTURBED = 3000, 400  # word forms that count as toxic, by their texts; and of them those with perturbed copies
MOST_COMMON, MOST_DRAWN, MOST_HARD = 1500, 6000, 2000  # clean forms: the most common, drawn ones, and a round's highest scored
LANDMARKS, DECAY, SPAN = 160, 0.65, 6
SYMBOLS, CHUNK, STEP = 64, 24, 12
MOST_CACHED = 1_000_000
MARKS = ".-*_'"
COST = 3000.0
STEMS = (4, 5, 6)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' characters as numbers below SYMBOLS, one after the other, and their lengths."""
    at = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = (code >= 97) & (code <= 122)
    return np.where(letter, code - 96, 27 + code % (SYMBOLS - 27)), at


def triples(words: list[str]):
    """(word, subsequence, weight) for each subsequence of each word, equal ones merged, weights
    normalised to length one. Words have at most CHUNK characters."""
    flat, sizes = symbols(words)
    starts = np.cumsum(sizes) - sizes
    parts = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if n == 0:
            continue
        m = flat[starts[rows][:, None] + np.arange(n)]
        idx = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
        if not idx:  # a word of one or two characters is its own single feature
            m = np.pad(m, ((0, 0), (0, 3 - n)))
            idx = [(0, 1, 2)]
        i, j, k = np.array(idx).T
        code = (m[:, i] * SYMBOLS + m[:, j]) * SYMBOLS + m[:, k]
        weight = np.broadcast_to((DECAY ** (k - i + 1)).astype(np.float64), code.shape)
        order = np.argsort(code, axis=1, kind="stable")
        code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(weight.ravel(), at)
        row = at // code.shape[1]
        norm = np.sqrt(np.bincount(row, total * total, len(rows)))
        parts.append((rows[row], code.ravel()[at], total / norm[row]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def chunked(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of over CHUNK characters in overlapping pieces; the word of each piece."""
    out, owner = [], []
    for k, w in enumerate(words):
        if len(w) <= CHUNK:
            out.append(w)
            owner.append(k)
        else:
            pieces = [w[i : i + CHUNK] for i in range(0, len(w) - STEP, STEP)]
            out += pieces
            owner += [k] * len(pieces)
    return out, np.array(owner, np.int64)


def units(text: str | None) -> list[str]:
    """The words that are scored: lower-cased, outer marks stripped; runs of three or more
    one-letter words as one word."""
    words = [x for w in (text or "").lower().split() if (x := w.strip(".,;:!?\"()[]"))]
    if not any(len(a) == 1 == len(b) for a, b in zip(words, words[1:], strict=False)):
        return words
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) > 2 else run
        run = []
        out.append(w)
    return out[:-1]


class Model:
    """weights by subsequence, bias, and the text layer; constant: the score where nothing could be learned."""

    def __init__(self, table=None, bias: float = 0.0, layer=None, constant: float | None = None):
        self.table, self.bias, self.layer, self.constant = table, bias, layer, constant
        self.kept: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """A score for each word: above 0 on the toxic side."""
        pieces, owner = chunked(words)
        row, code, value = triples(pieces)
        got = np.bincount(row, value * self.table[code], len(pieces)) + self.bias
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, got)
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        split = [units(t) for t in texts]
        if len(self.kept) > MOST_CACHED:
            self.kept.clear()
        new = list(set().union(*split) - self.kept.keys())
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.kept.update(zip(part, self.words(part).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for k, words in enumerate(split):
            s = np.fromiter(map(self.kept.__getitem__, words), float, len(words))
            if len(s):
                top = np.partition(s, -2)[-2:] if len(s) > 1 else np.array([-1.0, s[0]])
                out[k] = np.clip(top[1], -4, 4), np.clip(top[0], -4, 4), np.log1p((s > 0).sum())
            else:
                out[k] = -2, -2, 0
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        w, b, mean, sd = self.layer
        return 1 / (1 + np.exp(-np.clip((self.features(texts) - mean) / sd @ w + b, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the points inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1]) / c
    ridge[-1, -1] *= 0.01
    for _ in range(steps):
        on = y * (x1 @ w) < 1
        a = x1[on] * weight[on][:, None]
        new = np.linalg.solve(ridge + a.T @ x1[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple:
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * l2
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1], mean, sd


def _spread(texts: list[str | None]) -> dict[str, int]:
    """In how many texts each word occurs, and each stem, marked by a tilde."""
    out: dict[str, int] = {}
    for t in texts:
        words = {w for w in units(t) if w and w[-1] != "~"}
        for w in words | {w[:k] + "~" for w in words if len(w) <= CHUNK for k in STEMS if len(w) > k}:
            out[w] = out.get(w, 0) + 1
    return out


def _surprise(b: int, g: int, share: float) -> float:
    """The log-likelihood ratio of b toxic and g other texts, if toxic ones are over their share."""
    n = b + g
    if b <= n * share:
        return 0.0
    return 2 * (b * np.log(b / (n * share)) + (g * np.log(g / (n * (1 - share))) if g else 0.0))


def perturbed(word: str, rng: np.random.Generator) -> list[str]:
    """Copies of a word with characters inserted."""
    i = int(rng.integers(1, max(2, len(word))))
    mark = MARKS[int(rng.integers(len(MARKS)))]
    return [word[:i] + mark + word[i:], mark.join(word), word[:i] + word[i - 1] * 2 + word[i:]]


def fit(toxic: list[str | None], other: list[str | None], landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """A model from the texts of both labels."""
    if not toxic or not other:
        return Model(constant=len(toxic) / max(1, len(toxic) + len(other)))
    rng = np.random.default_rng(seed)
    bad, good = (_spread(texts) for texts in (toxic, other))
    share, types = len(toxic) / (len(toxic) + len(other)), len(bad) + len(good)
    telling = {w for w, n in bad.items() if _surprise(n, good.get(w, 0), share) > 2 * np.log(20 * types)}
    # A word is toxic by itself or by its stem; the kernel carries that to forms not seen.
    positive = sorted((w for w in bad if w[-1] != "~" and 3 <= len(w) <= CHUNK and (w in telling or any(w[:k] + "~" in telling for k in STEMS) and not good.get(w))), key=lambda w: (-bad[w], w))[:MOST_POSITIVE]
    if not positive:
        return Model(constant=share)
    bad, good = ({w: n for w, n in c.items() if w[-1] != "~"} for c in (bad, good))
    common = sorted((w for w in good if len(w) <= CHUNK), key=lambda w: (-good[w], w))
    clean = [*common[:MOST_COMMON], *(common[i] for i in rng.permutation(len(common))[:MOST_DRAWN])]
    clean = list(dict.fromkeys(clean))
    marks = list(dict.fromkeys([*positive[: landmarks // 2], *(positive[i] for i in rng.permutation(len(positive))[: landmarks // 8]), *clean[: landmarks // 4], *(clean[i] for i in rng.permutation(len(clean))[: landmarks // 8])]))
    row, code, value = triples(marks)
    known, at = np.unique(code, return_inverse=True)
    base = np.zeros((len(known), len(marks)))
    base[at, row] = value
    lam, vec = np.linalg.eigh(base.T @ base)
    keep = lam > 1e-6 * lam.max()
    root = vec[:, keep] / np.sqrt(lam[keep])

    def mapped(words: list[str]) -> np.ndarray:
        """Nystrom features: kernel values against the landmarks times the inverse root."""
        out = np.zeros((len(words), len(marks)))
        for lo in range(0, len(words), 2000):
            r, c, v = triples(words[lo : lo + 2000])
            p = np.minimum(np.searchsorted(known, c), len(known) - 1)
            hit = known[p] == c
            np.add.at(out, lo + r[hit], v[hit][:, None] * base[p[hit]])
        return out @ root

    # Words count by how many toxic texts have them, their perturbed copies less.
    weighed = [(w, bad[w]) for w in positive] + [(x, 0.2 * bad[w]) for w in positive[:MOST_PERTURBED] for x in perturbed(w, rng) if len(x) <= CHUNK]
    pos, share_of = [w for w, _ in weighed], np.array([n for _, n in weighed], float)
    hard: list[str] = []
    sample = [w for w in common if good[w] >= 1]
    for _ in range(3):
        neg = [*clean, *hard]
        x = mapped([*pos, *neg])
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[share_of / share_of.sum(), np.full(len(neg), 1 / len(neg))]
        w, b = svm(x, y, weight * COST)
        table = np.zeros(SYMBOLS**3)
        table[known] = base @ (root @ w)
        model = Model(table, b)
        scores = np.concatenate([model.words(sample[lo : lo + 20_000]) for lo in range(0, len(sample), 20_000)])
        worst = np.argsort(-scores, kind="stable")[:MOST_HARD]
        hard = list(dict.fromkeys([*hard, *(sample[i] for i in worst)]))
    x = np.vstack([model.features(toxic), model.features(other)])
    model.layer = logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(other))])
    model.kept.clear()
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded sample of the labelled rows given."""
    by_id = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    parts = [by_id.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER))]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most SAMPLE_TOXIC + SAMPLE_OTHER rows
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(ids, "i").select("i", "y", "t").collect()
    rows.sort(key=lambda r: (r["i"], r["t"] or ""))
    return fit([r["t"] for r in rows if r["y"] == 1], [r["t"] for r in rows if r["y"] == 0])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(part.column(1).to_pylist()))], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, score double")
