"""N-gram Jaccard join with set-relation skipping.

Documents are sets of distinct word shingles (64-bit hashes). Two link if
100 * intersection >= percent * union. The result is exact:

1. Equal sets collapse to one class, by a 128-bit fingerprint, with its number of rows.
2. Shingles have one global order: frequent ones last, rarer before more frequent; others by hash.
   A set of n needs only its first n - ceil(percent/100 * n) + 1 in an index: linked sets meet there.
3. Index-level skipping: an entry holds its set's size and its position there. A list is sorted in
   blocks of one size, each by position. A set skips the blocks out of its size range, and within a
   block the entries too far from its own position for the overlap (what precedes, the shingle, what
   follows). A pair that shares too few indexed shingles for the overlap goes too.
4. Lists of frequent shingles (FREQUENT or more sets, or MOST_LISTED entries) make no pairs: their
   sets are tied to the list instead. Pairs and ties make families; linked sets share one.
5. Answer-level skipping: a family's sets, in blocks of bounded size, are compared through an index
   of the block. A leader's answer is its overlap with every set, read from the lists of all its
   shingles; the answer of a set that is highly similar to a leader is derived from the leader's:
   the lists of the shingles it lacks are taken off, those of the shingles it adds are put on, all
   others are skipped.

Scale: shingles go through shuffles packed as arrays, in buckets whose number follows the input; ties
are merged in each task before they are shuffled. Large families are dealt in blocks by size range
and hash, and only blocks whose size ranges can meet are brought together, so no task holds more
than two blocks of BLOCK shingles, and a set's number of links is a sum over its blocks. The table
of frequent shingles is broadcast up to MOST_FREQUENT; beyond that the threshold doubles: any
order is right. Id tables are broadcast up to BROADCAST_ROWS, else joined by shuffle. Intermediate
tables go after their last reader.

A 64-bit hash stands for a shingle: in a pair of sets with 10^4 shingles each, the chance that
a collision changes the intersection is below 10^-11.

Defined results: a document without words, or with a null text, has no shingles and links with
nothing. Every row is a document of its own: rows that repeat a doc_id and text link with each other,
rows that share a doc_id with different texts only if these link. A null doc_id is the smallest id.
An empty table gives no rows. Extra columns are dropped by join() and kept by first_of_each().
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import forget, small, trim, trimmed, written
from .components import components
from .shingles import SIZE, shingle_set

PERCENT = 75
FREQUENT = 40
MOST_LISTED = 48
MOST_FREQUENT = 4_000_000
BUCKET_BYTES = 16_000_000
HELD = 1_000_000  # shingles that a task gathers before it sends them
BLOCK = 2_500_000  # weight of one side of a block: a set weighs its shingles, LEAST_WEIGHT at least
LEAST_WEIGHT = 1250
_U = np.uint64


def prefix_length(n, percent: int = PERCENT):
    """How many first shingles of a set of n its index entries need."""
    return n - -(-n * percent // 100) + 1


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _halves(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
    return f[:, 0].copy(), f[:, 1].copy()


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], n_buckets: int):
    """(bucket, the columns' rows in it) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    return [(i, [c[a:b] for c in columns]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _buckets(docs: DataFrame) -> int:
    """A number of buckets in proportion to the text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // BUCKET_BYTES))


def _slices(b: pa.RecordBatch, rows: int = 500):
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


def summaries(docs: DataFrame, size: int, percent: int, n_buckets: int) -> DataFrame:
    """Rows of documents (their own columns but text, n, fingerprint f1, f2) and of frequent shingles
    (f1: the shingle, n: in how many rows; bucket -1), as one table: one reading of the texts serves both."""
    keys = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "n int", "f1 long", "f2 long", "bucket int", "blob binary"])
    names = [*(f.name for f in keys), "n", "f1", "f2", "bucket", "blob"]
    at = docs.columns.index("text")

    def read(batches):
        held, size_held, blank = [], 0, None

        def counts():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            rows = _dealt((token % _U(n_buckets)).astype(np.int32), [token, count.astype(np.uint32)], n_buckets)
            blobs = [len(t).to_bytes(8, "little") + t.tobytes() + zlib.compress(c.tobytes(), 1) for _, (t, c) in rows]
            m = len(rows)
            return pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in blank), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([i for i, _ in rows], pa.int32()), pa.array(blobs, pa.binary())], names=names)

        seen = 0
        for whole in batches:
            for b in _slices(whole):
                own = [b.column(k) for k in range(b.num_columns) if k != at]
                blank = [c.type for c in own]
                sets = [shingle_set(t, size) for t in b.column(at).to_pylist()]
                # Twice the prefix is counted, as frequent shingles leave it to others.
                low = [s[: 2 * prefix_length(len(s), percent)] for s in sets if len(s)]
                held += low
                size_held += sum(map(len, low))
                m = b.num_rows
                f1, f2 = _halves([fingerprint(s) for s in sets])
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int32()), pa.array(f1), pa.array(f2), pa.array(((seen + np.arange(m)) % n_buckets).astype(np.int32)), pa.nulls(m, pa.binary())], names=names)
                seen += m
                if size_held > HELD:
                    yield counts()
                    held, size_held = [], 0
        if held:
            yield counts()

    def count(batches):
        """Passes documents on; sums each bucket's shingle counts in runs that merge as they grow."""
        held: dict[int, list] = {}

        def merged(parts):
            token, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(token)
            token, n = token[order], n[order]
            edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            return token[edge], np.add.reduceat(n, edge)

        blank = None
        for b in batches:
            blob = b.column("blob")
            blank = [b.column(k).type for k in range(len(keys))]
            doc = b.filter(pa.compute.is_null(blob))
            if doc.num_rows:
                yield doc
            rows = b.filter(pa.compute.is_valid(blob))
            for i, x in zip(rows.column("bucket").to_pylist(), rows.column("blob").to_pylist(), strict=True):
                k = int.from_bytes(x[:8], "little")
                parts = held.setdefault(i, [])
                parts.append((np.frombuffer(x, np.uint64, k, 8), np.frombuffer(zlib.decompress(x[8 + 8 * k :]), np.uint32).astype(np.int64)))
                if len(parts) > 24:
                    held[i] = [merged(parts)]
        for parts in held.values():
            token, n = merged(parts)
            often = n >= FREQUENT
            token, n = token[often], n[often]
            k = len(token)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in blank), pa.array(np.minimum(n, 2**31 - 1).astype(np.int32)), pa.array(token.view(np.int64)), pa.nulls(k, pa.int64()), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary())], names=names)

    return docs.mapInArrow(trimmed(read), schema).repartition(n_buckets, "bucket").mapInArrow(trimmed(count), schema).drop("blob")


def _frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and each one's place in the order by frequency; with the least
    count doubled until they are few enough."""
    least = FREQUENT
    while found.filter(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    rows = found.filter(F.col("n") >= least).select("f1", "n").toPandas()
    token, n = rows["f1"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(token)
    token, n = token[order], n[order]
    rank = np.empty(len(token), np.int32)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    return token, rank


def ordered(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """A sorted set with its frequent shingles moved to the end, rarer ones first; how many aren't frequent."""
    token, rank = frequent
    if not len(token):
        return s, len(s)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    hot = token[at] == s
    if not hot.any():
        return s, len(s)
    late = s[hot][np.argsort(rank[at[hot]])]
    return np.concatenate([s[~hot], late]), len(s) - len(late)


def needed(nx, ny, percent: int):
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (nx + ny) // (100 + percent))


def list_pairs(token: np.ndarray, n: np.ndarray, pos: np.ndarray, node: np.ndarray, percent: int):
    """Pairs (a, b, shared, least) from the entries of a bucket's lists, and ties (a, b, 1, 0) from
    long ones. least: how many indexed shingles a pair must share to reach the overlap.

    A list is in blocks of one size, each by position. Partner after partner is tried for all
    entries at once: an entry out of a partner's size range is done with the list.
    """
    order = np.argsort(token, kind="stable")
    t = token[order]
    same = t[1:] == t[:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    order = order[np.lexsort((node[order], pos[order], n[order], token[order]))]
    token, n, pos, node = token[order], n[order].astype(np.int64), pos[order].astype(np.int64), node[order]
    fresh = np.ones(len(token), bool)  # a set that a repeated row brought twice stays once
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, n, pos, node = token[fresh], n[fresh], pos[fresh], node[fresh]
    if not len(token):
        return
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(first, len(token)))
    long = np.repeat(size > MOST_LISTED, size)
    if long.any():
        head = np.repeat(node[first], size)
        tied = np.unique(np.stack([head[long], node[long]]), axis=1)
        yield tied[0], tied[1], np.ones(tied.shape[1], np.int64), np.zeros(tied.shape[1], np.int64)
    end = np.repeat(first + size, size)
    end[long] = 0
    live = np.arange(len(token))
    held, total = [], 0
    for d in range(1, MOST_LISTED):
        live = live[live + d < end[live]]
        x, y = live, live + d
        inside = 100 * n[x] >= percent * n[y]
        live = live[inside]  # sizes rise: what follows is out of range too
        x, y = x[inside], y[inside]
        if not len(x):
            break
        need = needed(n[x], n[y], percent)
        near = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 >= need
        x, y, need = x[near], y[near], need[near]
        held.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), need - (-(-percent * n[y] // 100) - 1)))
        total += len(x)
        if total > 1_500_000:
            yield _counted(held)
            held, total = [], 0
    if held:
        yield _counted(held)


def _counted(held):
    a, b, least = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    edge = np.flatnonzero(np.append(np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[edge], b[edge], np.diff(np.append(edge, len(a))), least[edge]


def _ties(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the (shingle, set) pairs connect, few of them: a shingle's first set
    stands for it, each set has one link for each distinct such set, and each shingle one."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.append(True, token[1:] != token[:-1])
    head = np.repeat(node[first], np.diff(np.append(np.flatnonzero(first), len(token))))
    pairs = np.unique(np.stack([head, node]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return np.concatenate([pairs[0], node[first]]), np.concatenate([pairs[1], token[first].view(np.int64)])


def candidates(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int, n_buckets: int) -> DataFrame:
    """(u, v): links whose components hold all linked sets together. A set is the first half of its
    fingerprint, which at worst puts two sets in one family; a frequent shingle stands for itself."""
    held_frequent = texts.sparkSession.sparkContext.broadcast(frequent)
    kinds = [("bucket", pa.int32()), ("blob", pa.binary()), ("u", pa.int64()), ("v", pa.int64())]

    def rows(bucket, blob=None, u=None, v=None):
        k = len(bucket)
        cols = [bucket, blob, u, v]
        return pa.RecordBatch.from_arrays([pa.nulls(k, t) if c is None else pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[x for x, _ in kinds])

    def read(batches):
        rare, hot, total = [], [], 0

        def sent():
            token, node, n, pos = (np.concatenate(c) for c in zip(*rare, strict=True))
            parts = _dealt((token % _U(n_buckets)).astype(np.int32), [token, node, n, pos], n_buckets)
            if parts:
                yield rows([i for i, _ in parts], [len(t).to_bytes(8, "little") + t.tobytes() + f.tobytes() + zlib.compress(m.tobytes() + p.tobytes(), 1) for _, (t, f, m, p) in parts])
            token, node = (np.concatenate(c) for c in zip(*hot, strict=True))
            if len(token):
                u, v = _ties(token, node)
                yield rows(((u ^ v) % n_buckets).astype(np.int32), None, u, v)

        for whole in batches:
            for b in _slices(whole):
                for text in b.column(0).to_pylist():
                    s = shingle_set(text, size)
                    if not len(s):
                        continue
                    order, cold = ordered(s, held_frequent.value)
                    p, node = prefix_length(len(s), percent), int.from_bytes(fingerprint(s)[:8], "little", signed=True)
                    k = min(p, cold)
                    rare.append((order[:k], np.full(k, node, np.int64), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32)))
                    hot.append((order[cold : max(p, cold)], np.full(max(p - cold, 0), node, np.int64)))
                    total += p
                if total > HELD:
                    yield from sent()
                    rare, hot, total = [], [], 0
        if rare:
            yield from sent()

    def lists(batches):
        held: dict[int, list] = {}
        out = lambda u, v, c, least: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(c.astype(np.int32)), pa.array(least.astype(np.int32))], names=["u", "v", "c", "least"])
        for b in batches:
            tie = b.filter(pa.compute.is_null(b.column("blob")))
            if tie.num_rows:
                one = np.ones(tie.num_rows, np.int32)
                yield out(tie.column("u").to_numpy(), tie.column("v").to_numpy(), one, one * 0)
            packed = b.filter(pa.compute.is_valid(b.column("blob")))
            for i, x in zip(packed.column("bucket").to_pylist(), packed.column("blob").to_pylist(), strict=True):
                held.setdefault(i, []).append(x)
        for i in sorted(held):
            cols = []
            for x in held.pop(i):
                k = int.from_bytes(x[:8], "little")
                rest = np.frombuffer(zlib.decompress(x[8 + 16 * k :]), np.int32)
                cols.append((np.frombuffer(x, np.uint64, k, 8), np.frombuffer(x, np.int64, k, 8 + 8 * k), rest[:k], rest[k:]))
            token, node, n, pos = (np.concatenate(c) for c in zip(*cols, strict=True))
            del cols
            for u, v, c, least in list_pairs(token, n, pos, node, percent):
                for lo in range(0, len(u), 100_000):
                    p = slice(lo, lo + 100_000)
                    yield out(u[p], v[p], c[p], least[p])

    met = texts.mapInArrow(trimmed(read), "bucket int, blob binary, u long, v long").repartition(n_buckets, "bucket").mapInArrow(trimmed(lists), "u long, v long, c int, least int")
    return met.groupBy("u", "v").agg(F.sum("c").alias("c"), F.max("least").alias("least")).filter("c >= least").select("u", "v")


class Block:
    """An index of a block's sets, and the answers read from it or derived.

    sets: sorted shingles, distinct sets; own: the sets to find links for; other: the sets to link with.
    """

    def __init__(self, sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray, other: np.ndarray, percent: int = PERCENT):
        self.n, self.copies, self.other, self.percent = np.array([len(s) for s in sets], np.int64), copies, other, percent
        token, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1  # the others are in no answer
        name = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(sets)), self.n)
        keep = shared[at]
        at, owner = name[at[keep]], owner[keep]
        cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.sets = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        order = np.argsort(at, kind="stable")
        self.posted, self.start = owner[order], np.append(0, np.cumsum(count[shared]))
        self.mark = np.zeros(len(self.start), bool)
        self.own = own
        self.derived = 0  # answers that weren't read from all lists

    def scan(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the shingles each set has."""
        lo = self.start[tokens]
        size = self.start[tokens + 1] - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.bincount(self.posted[at], minlength=len(self.sets))

    def lacking(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The shingles of x that y lacks."""
        self.mark[y] = True
        out = x[~self.mark[x]]
        self.mark[y] = False
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of rows that each set links with, and a smallest set of its component here."""
        f = len(self.sets)
        number, label = np.zeros(f, np.int64), np.arange(f)
        most, leader, answers = np.zeros(f, np.int64), np.full(f, -1), {}
        for y in np.flatnonzero(self.own)[np.argsort(self.n[self.own], kind="stable")].tolist():
            mine, l = self.sets[y], int(leader[y])  # noqa: E741
            if l >= 0 and len(mine) + len(self.sets[l]) - 2 * most[y] < len(mine):
                over = answers[l] - self.scan(self.lacking(self.sets[l], mine)) + self.scan(self.lacking(mine, self.sets[l]))
                self.derived += 1
            else:
                over = self.scan(mine)
                answers[y] = over.astype(np.int32)
                nearer = over > most
                most[nearer], leader[nearer] = over[nearer], y
            hit = (100 * over >= self.percent * (self.n[y] + self.n - over)) & self.other & (over > 0)
            hit[y] = False
            hits = np.flatnonzero(hit)
            if len(hits):
                number[y] += self.copies[hits].sum()
                if not self.other[y]:
                    number[hits] += self.copies[y]
                joined = np.unique(np.append(label[hits], label[y]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        return number, label


def compare(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(f1, f2, links, r1, r2): for sets that have links in a block, how many rows they link with there
    and a set of their component. members: f1, f2, n, copies, label (the family); sets: f1, f2, s."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    weighed = members.select("f1", "f2", "n", "copies", "label", band.alias("band"), F.greatest("n", F.lit(LEAST_WEIGHT)).cast("long").alias("w"))
    sides = weighed.groupBy("label", "band").agg(F.sum("w").alias("w")).groupBy("label").agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("w") / BLOCK).cast("int")))).alias("sides"))
    sides = written(sides, "families")
    groups = max(1, -(-(sides.filter(F.col("total") <= BLOCK).agg(F.sum("total")).first()[0] or 0) // BLOCK))
    rows = weighed.join(small(sides), "label")
    one = F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(groups)).cast("string")).alias("key"), F.lit(0).alias("side"))

    def side_count(k):
        return F.coalesce(F.try_element_at("sides", k), F.lit(0))

    def key(*parts):
        return F.concat_ws("/", F.col("label").cast("string"), *[x.cast("string") for x in parts])

    mine = F.pmod(F.xxhash64("f1", "f2"), side_count(F.col("band"))).cast("int")
    listed = lambda k, body: F.transform(F.filter(F.sequence(F.lit(0), side_count(k)), lambda j: j < side_count(k)), body)
    same = listed(F.col("band"), lambda j: F.struct(key(F.col("band"), F.least(j, F.col("mine")), F.col("band"), F.greatest(j, F.col("mine"))).alias("key"), F.when(j == F.col("mine"), 0).when(F.col("mine") < j, 1).otherwise(2).alias("side")))
    up = listed(F.col("band") + 1, lambda j: F.struct(key(F.col("band"), F.col("mine"), F.col("band") + 1, j).alias("key"), F.lit(1).alias("side")))
    down = listed(F.col("band") - 1, lambda j: F.struct(key(F.col("band") - 1, j, F.col("band"), F.col("mine")).alias("key"), F.lit(2).alias("side")))
    places = F.when(F.col("total") <= BLOCK, F.array(one)).otherwise(F.concat(same, up, down))
    dealt = written(rows.withColumn("mine", F.when(F.col("total") > BLOCK, mine)).select("f1", "f2", "copies", F.explode(places).alias("p")).select("f1", "f2", "copies", "p.key", "p.side"), "dealt")
    shipped = sets.join(small(dealt), ["f1", "f2"])

    def linked(t: pa.Table) -> pa.Table:
        a, b = t["f1"].to_numpy(), t["f2"].to_numpy()
        keep = sorted({(x, y): k for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))}.values())
        t, a, b = t.take(pa.array(keep)), a[keep], b[keep]
        side = t["side"].to_numpy()
        s = [np.frombuffer(x.as_buffer(), np.uint64) for c in t["s"].chunks for x in c]
        number, label = Block(s, t["copies"].to_numpy(), side < 2, side != 1, percent).links()
        at = np.flatnonzero(number)
        del s
        trim()
        return pa.table([pa.array(x) for x in (a[at], b[at], number[at], a[label[at]], b[label[at]])], names=["f1", "f2", "links", "r1", "r2"])

    out = written(shipped.groupBy("key").applyInArrow(lambda t: linked(t), "f1 long, f2 long, links long, r1 long, r2 long"), "links")
    forget(sides, dealt)
    return out


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: id, text and more columns that tell rows apart. Gives its rows (these columns but text, n,
    f1, f2), and for sets with copies or links (f1, f2) the least row of their component and the number
    of rows they link with."""
    ship(docs.sparkSession)
    n_buckets = _buckets(docs)
    found = written(summaries(docs, size, percent, n_buckets), "sets")
    rows = found.filter("bucket >= 0").drop("bucket")
    frequent = _frequent(found.filter("bucket < 0"))
    key = F.struct(F.col("id").isNotNull().alias("has"), *[c for c in rows.columns if c not in ("n", "f1", "f2")])
    nodes = written(rows.filter("n > 0").groupBy("f1", "f2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")), "nodes")
    # Reading a copy's text again is needless: ids that are no class's first stay behind.
    first = nodes.select(F.col("first.id").alias("id"))
    copies = rows.join(nodes.filter("copies > 1").select("f1", "f2", F.col("first.id").alias("of")), ["f1", "f2"]).filter("not id <=> of").select("id").distinct()
    copies = written(copies.join(first.filter("id is not null"), "id", "left_anti"), "copies")
    texts = docs.join(small(copies), "id", "left_anti")
    links = written(candidates(texts.select("text"), frequent, size, percent, n_buckets), "candidates")
    family = components(links)
    forget(links)
    members = written(nodes.join(family, nodes["f1"] == family["node"]).select("f1", "f2", "n", "copies", "label", F.col("first.id").alias("id")), "members")
    forget(family)
    chosen = members.select(F.col("id").alias("of")).distinct()
    texts = docs.join(small(chosen), F.col("id").eqNullSafe(F.col("of")), "left_semi")

    def read(batches):
        for whole in batches:
            for b in _slices(whole):
                sets = [s for t in b.column(0).to_pylist() if len(s := shingle_set(t, size))]
                if sets:
                    f1, f2 = _halves([fingerprint(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["f1", "f2", "s"])

    linked = compare(members, texts.select("text").mapInArrow(trimmed(read), "f1 long, f2 long, s binary"), percent)
    forget(copies, members)
    node, root = F.struct("f1", "f2"), F.struct(F.col("r1").alias("f1"), F.col("r2").alias("f2"))
    labels = components(linked.select(node.alias("u"), root.alias("v")))
    number = linked.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    named = nodes.join(labels.select(F.col("node.f1").alias("f1"), F.col("node.f2").alias("f2"), "label"), ["f1", "f2"], "left").join(number, ["f1", "f2"], "left")
    named = named.filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", F.struct("f1", "f2")))
    named = written(named.select("f1", "f2", "first", "label", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "named")
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    out = written(named.join(heads, "label").select("f1", "f2", "head", "links"), "classes")
    forget(nodes, labels, linked, named)
    return rows, out


def _joined(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, *more: Column) -> DataFrame:
    """Each row's id and more columns, n, head (the least row of its component, null if it is alone) and links."""
    rows, classes = _classes(docs.select(F.col(doc_id).alias("id"), *more, F.col(text).alias("text")), size, percent)
    return rows.join(classes, ["f1", "f2"], "left")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (how many other rows it links with) for every row."""
    out = _joined(docs, doc_id, text, size, percent)
    alone = F.col("head").isNull()
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest id, then hash of all
    columns, null ids first. Documents without words are components of their own, and all stay."""
    names = docs.columns
    marks = [F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in names]).alias(f"h{k}") for k in (1, 2)]
    out = _joined(docs, doc_id, text, size, percent, *marks)
    key = F.struct(F.col("id").isNotNull().alias("has"), "id", "h1", "h2")
    heads = out.filter("head is not null").select("id", "h1", "h2", (F.col("head") == key).alias("stays"))
    heads = written(heads.groupBy("id", "h1", "h2", "stays").agg(F.count(F.lit(1)).alias("rows")), "heads")
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    marked = docs.select(whole.alias("row"), F.col(doc_id).alias("id"), *marks)

    def without(of: DataFrame, how: str) -> DataFrame:
        of = small(of.select(F.col("id").alias("i"), F.col("h1").alias("a"), F.col("h2").alias("b")))
        return marked.join(of, F.col("id").eqNullSafe(F.col("i")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")), how)

    twice = heads.filter("stays and rows > 1")
    once = without(heads.filter("not stays or rows > 1"), "left_anti").select("row.*")
    if twice.isEmpty():
        return once
    # Rows alike in every column: one of them stays.
    return once.unionByName(without(twice, "left_semi").dropDuplicates(["id", "h1", "h2"]).select("row.*"))
