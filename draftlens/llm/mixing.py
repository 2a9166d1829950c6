"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are dealt by a seeded hash into blocks. Its target, in words, is met by
whole epochs plus a part epoch: blocks in permuted order until the rest is reached, the last
one cut inside. The drawn blocks of all sources are the balls of an urn; a tree halves the
output shards again and again, and at each node the left half's counts per source are one
multivariate-hypergeometric draw from the node's exact counts. A leaf's counts are cut from
each source's permuted block sequence, so shards are disjoint and the quotas exact. shuffled() writes
the mix out shard by shard, each in the order of a seeded hash.

Shards follow the words, SHARD_WORDS each, and are LEAST_SHARDS at least, so every mix is split by the tree.
Texts are read once for their sizes; (source, hash, size) rows are kept, and only block sums
(source, block, words) go further: their number grows with rows over BLOCK_ROWS. Tables of sources and
blocks are joined by broadcast while they have at most BROADCAST_ROWS rows, else by a shuffle. A hot source is
spread over its many blocks.

Defined results: a null text has size 0; null is a source of its own, last in order; sources
without words have target 0; an empty table gives an empty mix. Rows count one by one: those alike in id,
text and source share a hash, and where a cut falls among them, as many as fit are taken. Of own columns, those
of the names of added ones are replaced by mix(), and all are kept by shuffled(). Reruns agree: all draws come from
the seed, and sums are of integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, forget, small, words_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 200
SHARD_WORDS = 5_000_000  # some 35 MB of text, which a task sorts and writes and a later one reads as a whole
LEAST_SHARDS = 8
SEED = 20


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.size(words_of(text)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words per source, sources in order: share of all words by weight, none above most times its
    own size; what is above is dealt again by weight among the others until none is above."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    cap, out, open_ = [most * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * unit > cap[i]]
        if not over:
            for i in open_:
                out[i] = w[i] * unit
            break
        for i in over:
            out[i] = cap[i]
            left -= cap[i]
            open_.remove(i)
    return out


def _rng(seed: int, *path: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, path)).encode(), digest_size=8).digest(), "big"))


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """How many blocks of each source go to each shard: array shards x sources. Every split is a
    multivariate-hypergeometric draw, so all sums are exact and each shard is a fair sample."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1 or not have.sum():
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = int(have.sum()) * (mid - lo) // (hi - lo)
        got = _rng(seed, lo, hi).multivariate_hypergeometric(have, left, method="marginals")
        todo += [(lo, mid, got), (mid, hi, have - got)]
    return out


ADDED = ("size", "source_size", "target", "shards")


def _seeded(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """row (all columns), s (the source), h (the row's hash), size."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col(source))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("s"), h.alias("h"), size_of(F.col(text)).alias("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and shards: the output shards of the document's copies,
    one entry for each copy (none: not drawn)."""
    out, _ = _mixed(docs, doc_id, text, source, weights, share, most, seed)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, weights, share: float, most: float, seed: int) -> tuple[DataFrame, int]:
    """row, h and the ADDED columns; the number of shards."""
    spark = docs.sparkSession
    rows = _seeded(docs, doc_id, text, source, seed)
    light = written(rows.select("s", "h", "size"), "mix-sizes")
    by = light.groupBy("s").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    found = sorted(by.collect(), key=lambda r: (r["s"] is None, r["s"] or ""))
    goal = targets([int(r["words"]) for r in found], weights, share, most)
    plan = [(i, r["s"], int(r["words"]), float(g), max(1, -(-int(r["n"]) // BLOCK_ROWS))) for i, (r, g) in enumerate(zip(found, goal, strict=True))]
    kind = light.schema["s"].dataType.simpleString()
    sources = small(few_rows(spark, plan, f"i int, of {kind}, source_size long, target double, n_blocks long"))

    def placed(x: DataFrame) -> DataFrame:
        return x.join(sources, F.col("s").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("h", "n_blocks"))

    sums = placed(light).groupBy("i", "block").agg(F.sum("size").alias("words"))
    n_shards = max(LEAST_SHARDS, -(-int(sum(p[3] for p in plan)) // SHARD_WORDS))
    drawn = _draw(sums, plan, n_shards, seed)
    # Inside the one cut block of a source, copies go to documents in hash order up to the cut; rows of one hash are alike.
    cut = drawn.filter("cut is not null").select("i", "block", "cut")
    inner = placed(light).join(small(cut), ["i", "block"]).groupBy("i", "cut", "h").agg(F.count(F.lit(1)).alias("m"), F.max("size").alias("size"))
    order = Window.partitionBy("i").orderBy("h")
    inner = inner.withColumn("before", F.coalesce(F.sum(F.col("m") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = inner.filter(F.col("before") + F.col("m") * F.col("size") > F.col("cut")).groupBy("i").agg(F.min_by(F.struct("h", "m", ((F.col("cut") - F.col("before")) / F.col("size") + 0.5).cast("long").alias("k")), "h").alias("at"))
    blocks = drawn.join(small(at), "i", "left").select(F.col("i").alias("bi"), F.col("block").alias("bb"), "whole", "part", "cut", "at")
    blocks = written(blocks, "mix-plan")
    forget(drawn)
    none = F.array().cast("array<int>")
    edge = F.col("cut").isNotNull() & F.coalesce(F.col("h") == F.col("at.h"), F.lit(False))
    taken = F.col("cut").isNull() | F.coalesce(F.col("h") < F.col("at.h"), F.lit(True)) | (edge & (F.col("at.k") >= F.col("at.m")))
    out = placed(rows).join(small(blocks), (F.col("i") == F.col("bi")) & (F.col("block") == F.col("bb")))
    out = out.withColumns({"whole": F.coalesce("whole", none), "part": F.coalesce("part", none), "more": taken, "some": edge & (F.col("at.k") > 0) & (F.col("at.k") < F.col("at.m"))})
    shards = F.concat("whole", F.when(F.col("more"), F.col("part")).otherwise(none)).alias("shards")
    plain = out.select("row", "h", "size", "source_size", "target", shards, "some")
    if blocks.filter("cut is not null and at.k > 0 and at.k < at.m").isEmpty():
        return plain.drop("some"), n_shards
    # A cut among rows alike: they are counted, and the first k of them have the part epoch's copy.
    alike = out.filter("some").groupBy("row", "h", "size", "source_size", "target", "whole", "part", F.col("at.k").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    alike = alike.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("j"))
    alike = alike.select("row", "h", "size", "source_size", "target", F.concat("whole", F.when(F.col("j") <= F.col("k"), F.col("part")).otherwise(none)).alias("shards"))
    return plain.filter("not some").drop("some").unionByName(alike), n_shards


def _draw(sums: DataFrame, plan: list[tuple], shards: int, seed: int) -> DataFrame:
    """A row for each block: whole (the shards of its whole epochs), part (its shard in the part
    epoch, if drawn), cut (how many words of the block the part epoch takes, if not all)."""
    spark = sums.sparkSession
    facts = small(few_rows(spark, [(i, int(g // w) if w else 0, g - (g // w) * w if w else 0.0) for i, _, w, g, _ in plan], "i int, epochs int, rest double"))
    order = Window.partitionBy("i").orderBy("r", "block")
    ranked = sums.join(facts, "i").withColumn("r", F.xxhash64(F.lit(seed + 1), "i", "block"))
    ranked = ranked.withColumns({"k": F.row_number().over(order) - 1, "to": F.sum("words").over(order)})
    ranked = ranked.withColumn("drawn", (F.col("to") - F.col("words")) < F.col("rest"))
    ranked = ranked.withColumn("cut", F.when(F.col("drawn") & (F.col("to") > F.col("rest")), F.col("rest") - (F.col("to") - F.col("words"))))
    ranked = written(ranked, "mix-blocks")
    got = {r["i"]: (int(r["n"]), int(r["epochs"]), int(r["drawn"])) for r in ranked.groupBy("i", "epochs").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("drawn").cast("int")).alias("drawn")).collect()}
    quotas = [got.get(p[0], (0, 0, 0)) for p in plan]
    balls = [n * e + d for n, e, d in quotas]
    tree = split_tree(balls, shards, seed) if balls else np.zeros((1, 0), np.int64)
    ends, of_source = np.cumsum(tree, axis=0), np.array([(n, e) for n, e, _ in quotas] or [(0, 0)], np.int64)

    # Ball e * n + k of a source is block k in epoch e; it goes to the shard whose range of the
    # source's sequence holds it.
    def place(batches):
        for b in batches:
            whole, part = [], []
            for i, k, drawn in zip(b["i"], b["k"], b["drawn"], strict=True):
                n, epochs = of_source[i]
                at = np.searchsorted(ends[:, i], np.arange(epochs + 1) * n + k, side="right").tolist()
                whole.append(at[:-1])
                part.append(at[-1:] if drawn else [])
            yield b[["i", "block", "cut"]].assign(whole=whole, part=part)

    return written(ranked.select("i", "block", "k", "drawn", "cut").mapInPandas(place, "i int, block long, cut double, whole array<int>, part array<int>"), "mix-drawn")


def shuffled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each copy, with the columns of docs. A partition holds one shard,
    in the order of a seeded hash."""
    out, n_shards = _mixed(docs, doc_id, text, source, weights, share, most, seed)
    copies = out.select("row", "h", F.posexplode("shards").alias("copy", "shard"))
    dealt = copies.repartitionById(n_shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 2), "h", "copy"), "copy")
    return dealt.select("row.*")
