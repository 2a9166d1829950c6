"""The corpus operators do the whole job: nothing folded together, held back or cut short."""

import random

import numpy as np
from draftlens.llm import lm_score


def some_texts(n, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_lm_counts_are_all_texts(spark):
    """The shuffled tables are those of all texts counted in one place, the sample's rows included."""
    texts = [*some_texts(300), "", None]
    df = spark.createDataFrame([(t, k % 9 == 0) for k, t in enumerate(texts)], "text string, sample boolean")
    triples = np.zeros((257, 257, 257), np.int64)
    for t in texts:
        s = [lm_score.START, lm_score.START, *(t or "").encode(), lm_score.END]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            triples[a, b, c] += 1
    assert np.array_equal(lm_score.triple_counts(df.select("text")), triples.ravel())
    code, sizes = lm_score.Code(triples.ravel()), lm_score.table_sizes(20_000)
    assert 0 < code.trees < lm_score.MOST_TREES
    rest, every = lm_score.tables_of(df.repartition(5), code, sizes, 3)
    for got, mine in ((every, texts), (rest, [t for k, t in enumerate(texts) if k % 9])):
        want = [np.zeros(2 * size, np.uint32) for size in sizes]
        for part in lm_score.parts_of(mine, 3000):
            lm_score.counted(code, [mine[k] for k in part], want)
        assert all(np.array_equal(g, lm_score.odds(w[1::2], w[::2])) for g, w in zip(got, want, strict=True))
        symbols = sum(len((t or "").encode()) + 1 for t in mine)
        assert all(w.sum() > symbols for w in want)


def test_lm_learns_from_fewer_rows_than_the_weights_sample(spark):
    texts = some_texts(60)
    df = spark.createDataFrame(list(enumerate(texts)), "h1 long, text string")
    model = lm_score.fit(df, sum(map(len, texts)), len(texts))
    fresh = some_texts(80)[60:]
    plain = lm_score.Model(model.code, [t * 0 for t in model.tables]).bits(fresh).sum()
    assert all(t.any() for t in model.tables) and model.bits(fresh).sum() < 0.8 * plain


def test_lm_tables_grow_with_training():
    sizes = [sum(lm_score.table_sizes(n)) for n in (10**5, 10**6, 10**7, 10**8)]
    assert sizes == sorted(set(sizes))


def test_lm_weights_are_learnt_from_all_texts(spark):
    """Every decision of every training text teaches the weights, each by the counts of texts before it."""
    texts = [*some_texts(700), "", None]
    n_bytes = sum(len(t or "") for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "h1 long, text string")
    model = lm_score.fit(df.coalesce(1), n_bytes, len(texts))
    sizes = [len(t) for t in model.tables]
    alone, counts = lm_score.Learner(model.code, sizes), [np.zeros(2 * n, np.uint32) for n in sizes]
    for part in lm_score.parts_of(texts, alone.most):
        lm_score.counted(model.code, [texts[k] for k in part], counts, alone)
    assert model.learnt == counts[0].sum() == alone.met.sum() and alone.seen.sum() == alone.met.sum()
    assert np.allclose(model.weights, alone.weights, atol=1e-5) and np.allclose(model.refining, alone.refining, atol=1e-5)
    assert all(np.array_equal(t, lm_score.odds(c[1::2], c[::2])) for t, c in zip(model.tables, counts, strict=True))
    dealt = lm_score.fit(df.repartition(4), n_bytes, len(texts))  # several tasks: the same counts, all texts again
    assert dealt.learnt == model.learnt and all(np.array_equal(a, b) for a, b in zip(dealt.tables, model.tables, strict=True))
    fresh = some_texts(760)[700:]
    plain = lm_score.Model(model.code, model.tables)
    assert max(model.bits(fresh).sum(), dealt.bits(fresh).sum()) < plain.bits(fresh).sum()


def test_encoder_needs_no_offsets():
    """Ids equal the library's for white space of every shape, and the library is never asked for offsets, which cost time."""
    from draftlens.llm import queries, token_store

    class Fast:
        def __init__(self, tok):
            self.encode_batch_fast = tok.encode_batch_fast

    e = token_store.Encoder(queries.tokenizer_path())
    e.tok = Fast(e.tok)
    rng = random.Random(5)
    bits = ["word", "Zü", "a.", "b,", ".", ",", "9", "x\x00y", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "'s", "\U0001d11e"]
    for n in (1, 2, 3, 40):
        texts = ["".join(rng.choice(bits) for _ in range(n)) for _ in range(1500)] + ["one two\n\n three, end.", "last\xa0", "\xa0first", "\n", " "]
        assert e(texts) == e.library(texts) == e(texts)


def test_lm_looks_up_few_decisions_at_once(monkeypatch):
    """Decisions are looked up a cached slice at a time, in counting and in scoring, and all of them; what is read beside a text doesn't move its bits."""
    texts = [*some_texts(300), "", None, "ab " * 3000, *some_texts(300, seed=7)]
    sizes, counts = lm_score.table_sizes(20_000), np.zeros((257, 257, 257), np.int64)
    for t in texts[::2]:
        s = [lm_score.START, lm_score.START, *(t or "").encode(), lm_score.END]
        np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    code = lm_score.Code(counts.ravel())
    most, seen = 1 << 11, []
    look = lm_score.Model.looked_up

    def looked_up(self, *given):
        out = look(self, *given)
        seen.append(out[0].shape[1])
        return out

    monkeypatch.setattr(lm_score.Model, "looked_up", looked_up)
    monkeypatch.setattr(lm_score, "FIT_STEP", most)
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    monkeypatch.setattr(lm_score, "ABREAST", 128)
    learner, found = lm_score.Learner(code, sizes), [np.zeros(2 * n, np.uint32) for n in sizes]
    lm_score.counted(code, texts, found, learner)
    total = int(found[0].sum())
    assert max(seen) <= most and sum(seen) == total == learner.met.sum()
    model = lm_score.Model(code, [lm_score.odds(c[1::2], c[::2]) for c in found])
    seen.clear()
    runs = list(lm_score.side_by_side(texts))
    assert sorted(k for r in runs for k in r) == list(range(len(texts)))
    bits = np.zeros(len(texts))
    for r in runs:
        bits[r] = model.bits([texts[k] for k in r])
    assert max(seen) <= most and sum(seen) == total
    assert np.allclose(bits, [model.bits([t])[0] for t in texts], rtol=1e-5)
