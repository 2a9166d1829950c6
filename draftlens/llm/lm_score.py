"""LM scoring by online logistic context mixing, and add-one word scores beside it.

A text's bytes and an end symbol are coded by binary decisions: the two bytes before have a Huffman tree
of what follows them in training. Bit predictors look at a decision's place in the tree and its context: the
two bytes before (exact counts), the last three and five bytes, and the word begun with the one before it (hashed
contexts). Each gives the log odds of what training texts did there, 0 where training has nothing.
A logistic mixer adds them with weights that a gate picks (which long contexts are known, depth
in the tree, place in the word), and a refining table adds a correction by the mixed odds. Both start
from a fit on all training texts and are refined adaptively while a text is read, block after block,
anew for each text: what a block teaches serves the blocks after it, so the product of all
predictions is a probability of the text, and bits per byte are its logarithm. (The tree for the rest has the
symbols of the tree before it too, so all symbols together have a little less than one.)

Counts come from all training texts, whole. A hashed predictor has a table of SLOTS_ROOT times the root of the
training bytes, to the next power of two: contexts worth telling apart grow about so (Heaps' law). It ends at
MOST_SLOTS, the bound of what each worker holds. The table is counted in few tasks, as many as keep its parts
below the text in size, summed by slot range, and broadcast as signed bytes.
The first weights are learnt from all training texts by the tasks that count them: each run of texts is predicted by the
hashed counts of those that its task met before (the two bytes' counts are of all texts, its own included), then counted; the tasks' weights are averaged by the decisions they come
from. How rows are dealt to tasks so moves the weights a little; the same files dealt alike give the same. Word counts are exact: 64-bit word hashes with counts, packed by bucket. A text's
words are looked up in the buckets, but for the HOT_WORDS most frequent, which are broadcast and looked up in
place, so no bucket grows with the number of documents.

Memory: texts are read in runs of CHUNK (in scoring RUN) characters and SEGMENT symbols of a text at a time, whatever its length;
their decisions are looked up FIT_STEP at a time, which stay in the processor's cache.

Defined results: null is the empty text, its end is scored; without training texts all counts
are 0; repeated rows score alike; a null id is kept, its row trains if the condition is null; extra
columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import forget, trimmed, written
from .shingles import words_in

ORDERS = (3, 5)
HASHED = len(ORDERS) + 1
INPUTS = HASHED + 1
END, START = 256, 256
BLOCK = 512  # symbols between refinements
RATE, REFINE = 0.06, 0.07
FIT_RATE, FIT_STEP, GROWTH = 0.15, 1 << 15, 3  # of the first weights: rate, decisions a step, growth of the counts between tables
SLOTS_ROOT = 512
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24
RANGE, LESSON = 1 << 18, -1  # slots summed together; the number of what a task learnt, beside those of its ranges
TASK_ROWS = 100
HOT_WORDS = 200_000
WORD_BUCKET_BYTES = 48_000_000
CHUNK = 100_000  # characters read at once
PART_TEXTS = 2000
PIECE = 1 << 14  # symbols whose contexts are made together
ABREAST, RUN = 1 << 14, 300_000  # symbols of a block read together, and characters of a run of such texts
SEGMENT, LEAD, WORD = 1 << 18, 16, 8  # symbols of one text at a time, and the bytes before that contexts reach back to
DEPTHS, CELLS = 6, 33
MOST_TREES, LEAST_SEEN, NODES, TURN = 4096, 64, 512, 77
GATES = 4 * DEPTHS * 2
_L = np.uint64
_M = [_L(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def huffman(counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each symbol the nodes on its way and the bits taken there."""
    heap = [(int(c), i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    nxt = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]], up[b[2]] = (nxt, 0), (nxt, 1)
        heapq.heappush(heap, (a[0] + b[0], nxt, nxt))
        nxt += 1
    nodes, bits = [], []
    for s in range(len(counts)):
        way, at = [], s
        while at in up:
            at, bit = up[at]
            way.append((at - len(counts), bit))
        way.reverse()
        nodes.append(np.array([w[0] for w in way], np.int32))
        bits.append(np.array([w[1] for w in way], np.uint8))
    return nodes, bits


def odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """A sixteenth of the log odds, as signed bytes; 0 without counts."""
    return np.clip(np.round(16 * np.log((ones + 0.35) / (zeros + 0.35))), -127, 127).astype(np.int8)


class Code:
    """Trees of what follows the two bytes before, for the MOST_TREES most frequent pairs with LEAST_SEEN or more, with a
    leaf for all that never did; it, and other pairs, go on in a tree of what follows the byte before, which has
    all symbols. counts: of (byte before the last, last byte, symbol); START before the first."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(257 * 257, 257)
        seen = counts.sum(1)
        chosen = np.argsort(-seen, kind="stable")[:MOST_TREES]
        chosen = chosen[seen[chosen] >= LEAST_SEEN]
        self.tree = np.full(257 * 257, -1, np.int32)
        self.tree[chosen] = np.arange(len(chosen))
        ways, bits, ones, every = [], [], np.zeros((len(chosen) + 257, NODES), np.int64), np.zeros((len(chosen) + 257, NODES), np.int64)
        # The way of each symbol in each tree, the last of a tree's being the leaf for the rest; -1 for none. The trees by one byte come last.
        way = np.full((len(chosen) + 257, 258), -1, np.int32)

        last = counts.reshape(257, 257, 257).sum(0)
        total, plain = last.sum(0), None
        for t, c in enumerate(chosen):
            has = np.flatnonzero(counts[c])
            real = np.append(counts[c][has], 0)
            weights = np.append(counts[c][has], len(has) // 2 + 1)
            nodes, taken = huffman(weights)
            way[t, np.append(has, 257)] = len(ways) + np.arange(len(has) + 1)
            for k, n, b in zip(real, nodes, taken, strict=True):
                ways.append(n)
                bits.append(b)
                every[t][n] += k
                ones[t][n] += k * b
        # Of the trees by one byte, what a tree by two already had is in the counts too: they are for the rest.
        for p in range(257):
            if not last[p].any() and plain:
                nodes, taken = plain
            else:
                # What never followed this byte keeps a long way, by how frequent it is at all.
                nodes, taken = huffman(last[p] * (1 << 20) + total * 16 // max(1, int(total.sum()) >> 10) + 1)
                if not last[p].any():
                    plain = nodes, taken
            way[len(chosen) + p, :257] = len(ways) + np.arange(257)
            for s, n, b in zip(range(257), nodes, taken, strict=True):
                ways.append((n + TURN) % NODES)
                bits.append(b)
                if last[p][s]:
                    every[len(chosen) + p][ways[-1]] += last[p][s]
                    ones[len(chosen) + p][ways[-1]] += last[p][s] * b
        self.trees = len(chosen)
        #: The tree of each two bytes, and its last byte.
        self.place = np.where(self.tree < 0, len(chosen) + np.arange(257 * 257) % 257, self.tree).astype(np.intp)
        last_of = np.append(chosen % 257, np.arange(257))
        length = np.array([len(x) for x in ways], np.int64)
        start = np.cumsum(length) - length
        # All that a decision needs of each step of each way: the node's low bits, the bit, whether a word is
        # begun (the last byte is no gap), the depth, and the odds of what training texts did there.
        place = np.zeros(len(ways), np.int64)
        place[way[way >= 0]] = np.nonzero(way >= 0)[0]
        place, node = np.repeat(place, length), np.concatenate(ways).astype(np.int64)
        first = odds(ones, every - ones).ravel()[place * NODES + node]
        depth = np.minimum(np.concatenate([np.arange(len(x)) for x in ways]), DEPTHS - 1)
        inside = ~np.append(_GAP, True)[last_of[place]]
        self.steps = (node & 31 | np.concatenate(bits).astype(np.int64) << 5 | inside << 6 | depth << 7 | first.astype(np.int64) << 10).astype(np.int32)

        #: Of each tree and symbol where its steps start, and in the low 8 bits how many; 0 for none.
        small = len(self.steps) < 1 << 24
        self.way = np.where(way < 0, 0, (start << 8 | length)[way]).astype(np.uint32 if small else np.uint64).ravel()
        if length.max() > 255:
            raise ValueError("a tree is deeper than 255")

    def decisions(self, two: np.ndarray, symbols: np.ndarray):
        """two: the two bytes before, as one number. How many decisions each symbol takes, which symbol each way is of (None if
        each has one), which way each decision is of, and its step: five bits of the node, then bit, inside a word, depth, odds."""
        place = self.place.take(two)
        place *= 258
        place += symbols
        way = self.way.take(place)
        rest, of = way == 0, None
        if rest.any():  # through the leaf for the rest, then the tree of the byte before
            left = np.flatnonzero(rest)
            of = np.arange(len(two) + len(left))
            of -= np.cumsum(np.bincount(left + 1 + np.arange(len(left)), minlength=len(of)))
            other = self.way.take((self.trees + two[left] % 257) * 258 + symbols[left])
            way[left] = self.way.take(place[left] - symbols[left] + 257)
            way = way.take(of)
            way[left + 1 + np.arange(len(left))] = other
        n, start = (way & 255).astype(np.intp), (way >> 8).astype(np.intp)
        ends = np.cumsum(n)
        owner = np.zeros(int(ends[-1]), np.intp)  # every way has a step at least
        owner[ends[:-1]] = 1
        np.cumsum(owner, out=owner)
        at = np.ones(len(owner), np.intp)
        at[0] = start[0]
        at[ends[:-1]] = start[1:] - start[:-1] - n[:-1] + 1
        steps = self.steps.take(np.cumsum(at, out=at))
        if of is not None:
            n = np.bincount(of, n).astype(np.intp)
        return n, of, owner, steps


def finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> _L(32)
    h *= _M[3]
    h ^= h >> _L(29)
    return h


def contexts(back: np.ndarray, raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """For each hashed input the hash of the context of each symbol. back: the eight bytes before each as one number, the
    last byte highest; raw, at: bytes and where in them the symbols are; inside: how many bytes of a word are before each."""
    out = [finished((back >> _L(64 - 8 * k)) * _M[0] + _L(k)) for k in ORDERS]
    # The word begun, WORD bytes of it at most, and of shorter ones the byte before the gap before them.
    size = np.minimum(inside, WORD)
    lead = raw.take(at - 2 - size).astype(np.uint64)
    lead *= inside < WORD
    size = size.astype(np.uint64)
    word = back >> ((_L(8) - np.maximum(size, _L(1))) << _L(3))
    word *= size > 0
    size *= _M[1]
    word += size
    word *= _M[2]
    lead *= _M[4]
    word += lead
    out.append(finished(word))
    return out


def lines(context: np.ndarray, slots: int) -> np.ndarray:
    """Where a context's nodes are in a table: a line of 32 slots, and in its low bits a turn of them."""
    return ((context >> _L(24)) & _L(slots - 1)).view(np.int64)


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def side_by_side(texts: list[str | None]):
    """The texts from short to long, in runs whose blocks go forward together: at most ABREAST symbols of a block, and some RUN characters."""
    held, n, wide = [], 0, 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k] or "")):
        size = min(len(texts[k] or "") + 1, SEGMENT)
        if held and (n + size > RUN or wide + min(size, BLOCK) > ABREAST):
            yield held
            held, n, wide = [], 0, 0
        held.append(k)
        n, wide = n + size, wide + min(size, BLOCK)
    if held:
        yield held


def parts_of(texts: list[str | None], most=CHUNK):
    """The texts in runs of about `most` characters (or as many as it gives when called) and at most PART_TEXTS texts."""
    held, n = [], 0
    for k, t in enumerate(texts):
        held.append(k)
        n += min(len(t or ""), SEGMENT)
        if n >= (most() if callable(most) else most) or len(held) == PART_TEXTS:
            yield held
            held, n = [], 0
    if held:
        yield held


class Run:
    """Some texts' next symbols, their contexts, and which text (number in the run) each is of."""

    def __init__(self, code: Code, texts: list[bytes], start: int, abreast: bool = False):
        live = [k for k, t in enumerate(texts) if len(t) >= start]
        pieces = [texts[k][max(0, start - LEAD) : start + SEGMENT] for k in live]
        blank, back = bytes(max(0, LEAD - start)), min(start, LEAD)
        ended = np.array([len(texts[k]) < start + SEGMENT for k in live])
        # Before each run of bytes LEAD of what came before, blank at a text's start; a byte for its end.
        self.raw = np.frombuffer(b"".join(x for t, end in zip(pieces, ended, strict=True) for x in (blank, t, b"\0" * bool(end))), np.uint8)
        self.size = np.array([len(t) - back for t in pieces], np.int64) + ended
        self.first, self.live, self.ended, self.start, self.code = np.cumsum(self.size + LEAD) - self.size, np.array(live), ended, start, code
        # Since which byte a word is begun.
        gap = _GAP.take(self.raw)
        if not start:
            for d in range(LEAD):
                gap[self.first - 1 - d] = True
        self.begin = np.arange(1, len(gap) + 1, dtype=np.int32)
        self.begin *= gap
        np.maximum.accumulate(self.begin, out=self.begin)
        if abreast:
            self.sort_by_block()
        else:
            self.read(np.arange(len(live)), np.zeros(len(live), np.int64), self.size)

    def sort_by_block(self) -> None:
        """Symbols by block, then text, so that the blocks of all texts go forward together."""
        many = -(-self.size // BLOCK)
        k = np.repeat(np.arange(len(many)), many)
        block = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(block, kind="stable")
        k, block = k[order], block[order]
        size = np.minimum(self.size[k] - block * BLOCK, BLOCK)
        self.read(k, block * BLOCK, size)
        self.block = np.repeat(block, size)

    def read(self, k: np.ndarray, begun: np.ndarray, size: np.ndarray) -> None:
        """The symbols of some pieces one after another: of text number k among the live ones, from a symbol on, so many."""
        n, head = int(size.sum()), np.cumsum(size) - size
        self.text_of = np.repeat(self.live[k], size)
        at = np.ones(n, np.intp)
        at[head] = self.first[k] + begun
        at[head[1:]] -= at[head[:-1]] + size[:-1] - 1
        np.cumsum(at, out=at)
        wide = np.ndarray(len(self.raw) - 7, "<u8", self.raw.data, 0, (1,))
        self.ctx = [np.empty(n, np.uint64) for _ in range(HASHED)]
        self.symbols, self.before = np.empty(n, np.intp), np.empty(n, np.intp)
        for lo in range(0, n, PIECE):  # few enough to stay in the processor's cache
            p, sl = at[lo : lo + PIECE], slice(lo, lo + PIECE)
            back = wide[p - 8]
            for whole, c in zip(self.ctx, contexts(back, self.raw, p, p - self.begin.take(p - 1)), strict=True):
                whole[sl] = c
            self.symbols[sl] = self.raw.take(p)
            self.before[sl] = (back >> _L(48) & _L(255)) * _L(257) + (back >> _L(56))
        of_end = head + size - 1
        self.symbols[of_end[self.ended[k] & (begun + size == self.size[k])]] = END
        if not self.start:
            begun_at = head[begun == 0]
            self.before[begun_at] = START * 257 + START
            second = begun_at[size[begun == 0] > 1] + 1
            self.before[second] = START * 257 + self.before[second] % 257

    def decisions(self, slots: list[int]):
        """(symbols' numbers of decisions, of each hashed input the lines of ways in tables of so many slots, the way and the step of each decision)."""
        n, of, owner, steps = self.code.decisions(self.before, self.symbols)
        at = [lines(c, k) for c, k in zip(self.ctx, slots, strict=True)]
        return n, at if of is None else [x.take(of) for x in at], owner, steps


def runs(code: Code, texts: list[str | None], abreast: bool = False):
    """All symbols of the texts, a SEGMENT of each at a time; text by text, or block by block."""
    raw = [bytes_of(t) for t in texts]
    for start in range(0, max(map(len, raw), default=-1) + 1, SEGMENT):
        yield Run(code, raw, start, abreast)


class Model:
    """The code, a table of odds for each hashed input, gated weights, and the refining table."""

    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables
        self.weights = np.full((INPUTS + 1, GATES), 0.3, np.float32)
        self.weights[-1] = 0
        self.refining = np.zeros(DEPTHS * CELLS, np.float32)
        self.learnt = 0  # decisions that these two were learnt from

    def decisions(self, run: Run):
        return run.decisions([len(t) for t in self.tables])

    def looked_up(self, at_lines: list[np.ndarray], owner: np.ndarray, step: np.ndarray):
        """(inputs, gate, sign of the bit, place in the refining table, slots in each hashed table) of decisions."""
        low = (step & 31).astype(np.intp)
        x = np.empty((INPUTS + 1, len(step)), np.float32)
        x[0] = step >> 10
        gate, slots = (step >> 6 & 15).astype(np.uint8), []
        row = gate >> 1
        row *= np.uint8(CELLS)
        for k, (line, table) in enumerate(zip(at_lines, self.tables, strict=True)):
            at = line.take(owner)
            at ^= low
            known = table.take(at)
            x[1 + k] = known
            if k >= HASHED - 2:
                gate += (known != 0).view(np.uint8) * np.uint8(2 * DEPTHS * (k - HASHED + 3))
            slots.append(at)
        x[:INPUTS] *= np.float32(1 / 16)
        x[INPUTS] = 0.3
        sign = (step >> 4 & 2).astype(np.float32)
        sign -= 1
        return x, gate.astype(np.intp), sign, row, slots

    def inputs(self, run: Run):
        """(symbols' numbers of decisions, inputs, gate, sign of the bit, place in the refining table) of a run's decisions."""
        n, *found = self.decisions(run)
        return n, *self.looked_up(*found)[:4]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = self.weights[0].take(gate, mode="clip")  # all are inside; this mode is the fastest
        z *= x[0]
        for k in range(1, INPUTS + 1):
            w = self.weights[k].take(gate, mode="clip")
            w *= x[k]
            z += w
        return z

    def cells(self, z: np.ndarray, row: np.ndarray) -> np.ndarray:
        cell = z * 2
        cell += np.float32(CELLS / 2)
        cell = np.clip(cell, 0, CELLS - 1, out=cell).astype(np.uint8)
        cell += row
        return cell.astype(np.intp)

    def bits(self, texts: list[str | None], rate: float = RATE) -> np.ndarray:
        """The bits of each text."""
        n_texts, width_of = len(texts), DEPTHS * CELLS
        out, shift = np.zeros(n_texts), np.zeros((n_texts, INPUTS + 1), np.float32)
        refining = np.tile(self.refining, (n_texts, 1))
        for run in runs(self.code, texts, abreast=True):
            width, *found = self.decisions(run)
            at_lines, owner, step = found
            ends = np.append(0, np.cumsum(width))
            last = int(run.block[-1])
            cuts = np.searchsorted(run.block, np.arange(last + 2))
            starts, begun, done = ends[cuts], 0, 0
            for block, (s0, s1) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if starts[block] == done:  # some blocks are looked up together, few enough to stay in the processor's cache
                    begun, done = done, int(starts[max(block + 1, np.searchsorted(starts, done + FIT_STEP, "right") - 1)])
                    x, gate, sign, row, _ = self.looked_up(at_lines, owner[begun:done], step[begun:done])
                    mixed = self.mixed(x, gate)
                sl = slice(int(starts[block]) - begun, int(starts[block + 1]) - begun)
                text_of = run.text_of[s0:s1]
                edge = np.append(0, np.flatnonzero(text_of[1:] != text_of[:-1]) + 1)
                live = text_of[edge]
                offs = ends[s0:s1][edge] - (begun + sl.start)
                count = np.diff(offs, append=sl.stop - sl.start)
                xs = x[:, sl]
                spans = [(t, slice(o, o + c)) for t, o, c in zip(live.tolist(), offs.tolist(), count.tolist(), strict=True)]
                z = mixed[sl]
                if block or run.start:
                    for t, part in spans:
                        z[part] += shift[t] @ xs[:, part]
                place = self.cells(z, row[sl])
                place += np.repeat(np.arange(len(live)) * width_of, count)
                z += refining[live].ravel().take(place, mode="clip")
                z *= sign[sl]
                np.clip(z, -30, 30, out=z)
                e = np.exp(np.negative(z, out=z), out=z)
                more = e + 1
                err = e / more
                err *= sign[sl]
                out[live] += np.add.reduceat(np.log(more, out=more), offs, dtype=np.float64)
                slopes = np.stack([xs[:, part] @ err[part] for _, part in spans])
                shift[live] += np.clip(slopes * (rate / np.sqrt(1.0 + count))[:, None], -0.2, 0.2)
                refining[live] += np.clip(REFINE * rate * np.bincount(place, err, len(live) * width_of), -0.1, 0.1).astype(np.float32).reshape(len(live), -1)
        return out / np.log(2)


class Learner(Model):
    """A model that learns the first weights and refining table from all texts while they are counted: each run of texts
    is predicted by the counts of those before it. The tables of odds are made anew whenever the counts have grown by GROWTH."""

    def __init__(self, code: Code, sizes: list[int]):
        super().__init__(code, [np.zeros(size, np.int8) for size in sizes])
        self.slopes = np.full(self.weights.shape, 1e-4)
        self.seen, self.met = np.zeros(GATES), np.zeros(DEPTHS * CELLS)
        self.read = self.due = 0

    def most(self) -> int:
        """Characters of the next run: few at first, as nothing is known yet."""
        return min(CHUNK, 1000 + self.read // 2)

    def learn(self, x: np.ndarray, gate: np.ndarray, sign: np.ndarray, row: np.ndarray) -> None:
        for lo in range(0, len(gate), FIT_STEP):
            sl = slice(lo, lo + FIT_STEP)
            xs, g = x[:, sl], gate[sl]
            z = self.mixed(xs, g)
            cell = self.cells(z, row[sl])
            z += self.refining.take(cell, mode="clip")
            z *= sign[sl]
            err = np.clip(z, -30, 30, out=z)
            err = 1 / (np.exp(err, out=err) + 1)
            err *= sign[sl]
            seen, met = np.bincount(g, minlength=GATES), np.bincount(cell, minlength=DEPTHS * CELLS)
            # Steps by the slopes met so far (Adagrad), of the mean over a gate's decisions.
            slope = np.stack([np.bincount(g, xs[k] * err, GATES) for k in range(INPUTS + 1)]) / np.sqrt(1 + seen)
            self.slopes += slope * slope
            self.weights += (FIT_RATE * slope / np.sqrt(self.slopes)).astype(np.float32)
            self.refining += np.clip(REFINE * np.bincount(cell, err, DEPTHS * CELLS) / np.sqrt(4 + met) / np.sqrt(1 + self.met / FIT_STEP), -0.1, 0.1).astype(np.float32)
            self.seen += seen
            self.met += met

    def counted(self, n: int, counts: list[np.ndarray]) -> None:
        """n more symbols are in the counts."""
        self.read += n
        if self.read < self.due:
            return
        self.due = GROWTH * self.read
        for table, found in zip(self.tables, counts, strict=True):
            for lo in range(0, len(table), RANGE):
                part = found[2 * lo : 2 * (lo + RANGE)]
                at = np.flatnonzero(part.view(np.uint64) != 0)
                if len(at):
                    table[lo + at] = odds(part[1::2][at], part[::2][at])

    def lesson(self) -> bytes:
        return b"".join(v.astype(np.float64).tobytes() for v in (self.weights * self.seen, self.seen, self.refining * self.met, self.met))


def taught(model: Model, total: np.ndarray) -> None:
    """Gives the model the means of what several tasks learnt, by the decisions they learnt it from. total: the sum of their lessons."""
    model.learnt = int(total[-model.refining.size :].sum())
    weights, seen, refining, met = np.split(total, np.cumsum([model.weights.size, GATES, model.refining.size]))
    weights = weights.reshape(model.weights.shape)
    model.weights = np.where(seen > 0, weights / np.maximum(seen, 1), model.weights).astype(np.float32)
    model.refining = np.where(met > 0, refining / np.maximum(met, 1), model.refining).astype(np.float32)


def table_sizes(n_bytes: int) -> list[int]:
    """Slots of each hashed input: by the root of the training bytes; shorter contexts are fewer."""
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_ROOT * n_bytes**0.5):
        slots *= 2
    return [min(slots, 1 << 22), slots // 2, slots]


def counted(code: Code, texts: list[str | None], tables: list[np.ndarray], learner: Learner | None = None) -> None:
    """Adds the texts' decisions to tables of (slot, bit) counts; a learner learns from them first."""
    slots = [len(t) // 2 for t in tables]
    for run in runs(code, texts):
        _, at_lines, owner, steps = run.decisions(slots)
        places = []
        for lo in range(0, len(steps), FIT_STEP):  # few enough to stay in the processor's cache
            of, step = owner[lo : lo + FIT_STEP], steps[lo : lo + FIT_STEP]
            if learner:
                *found, at = learner.looked_up(at_lines, of, step)
                learner.learn(*found)
            else:
                low = (step & 31).astype(np.intp)
                at = [line.take(of) ^ low for line in at_lines]
            places.append(at)
        bit = (steps >> 5 & 1).astype(np.intp)
        for k, table in enumerate(tables):  # a table at a time: its slots recur
            at = np.concatenate([found[k] for found in places])
            at <<= 1
            at |= bit
            np.add.at(table, at, np.uint32(1))
        if learner:
            learner.counted(len(run.symbols), tables)


def tables_of(train: DataFrame, code: Code, sizes: list[int], n_tasks: int, model: Model | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The tables of odds without the rows marked as sample, and of all rows. train: text, sample.
    Counts are summed by ranges of slots; odds come to the driver as a byte a slot. A model is given the
    weights and refining table that the tasks learn from all their texts not marked as sample."""
    teach = model is not None
    held = train.sparkSession.sparkContext.broadcast(code)
    ranges = [(k, lo) for k, size in enumerate(sizes) for lo in range(0, size, RANGE)]

    def count(batches):
        tables: dict[bool, list[np.ndarray]] = {}
        learner = None
        for b in batches:
            texts, sample = b.column(0).to_pylist(), b.column(1).to_pylist()
            for kind in (False, True):
                mine = [t for t, s in zip(texts, sample, strict=True) if s == kind]
                if teach and not learner:
                    learner = Learner(held.value, sizes)
                now = None if kind else learner
                for part in parts_of(mine, now.most if now else CHUNK):
                    if kind not in tables:
                        tables[kind] = [np.zeros(2 * size, np.uint32) for size in sizes]
                    counted(held.value, [mine[k] for k in part], tables[kind], now)
        if learner and learner.read:
            yield pa.RecordBatch.from_arrays([pa.array([LESSON], pa.int32()), pa.array([False]), pa.array([learner.lesson()], pa.binary())], names=["i", "sample", "blob"])
            learner = None
        for kind, found in tables.items():
            for i, (k, lo) in enumerate(ranges):
                part = found[k][2 * lo : 2 * (lo + RANGE)]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([kind]), pa.array([pa.compress(part, codec="zstd", asbytes=True)], pa.binary())], names=["i", "sample", "blob"])

    def add(batches):
        sums: dict[int, list] = {}
        lessons = []
        for b in batches:
            for i, kind, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i == LESSON:
                    lessons.append(x)
                    continue
                pair = sums.setdefault(i, [0, 0])
                pair[kind] = pair[kind] + np.frombuffer(pa.decompress(x, 8 * min(RANGE, sizes[ranges[i][0]]), codec="zstd"), np.uint32).astype(np.int64)
        for i, (rest, sample) in sums.items():
            both = rest + sample
            rest = rest if isinstance(rest, np.ndarray) else np.zeros_like(both)
            blobs = [odds(c[1::2], c[::2]).tobytes() for c in ((rest, both) if isinstance(sample, np.ndarray) else (both,))]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array(blobs[:-1] or [None], pa.binary()), pa.array(blobs[-1:], pa.binary())], names=["i", "rest", "every"])
        if lessons:  # sorted, so that the sum doesn't hang on which came first
            total = sum(np.frombuffer(x) for x in sorted(lessons))
            yield pa.RecordBatch.from_arrays([pa.array([LESSON], pa.int32()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["i", "rest", "every"])

    every = [np.zeros(size, np.int8) for size in sizes]
    rest = [np.zeros(size, np.int8) for size in sizes]
    kind = "i int, sample boolean, blob binary"
    parts = train.filter("not sample").coalesce(n_tasks).mapInArrow(trimmed(count), kind).union(train.filter("sample").coalesce(1).mapInArrow(trimmed(count), kind))
    summed = parts.repartition(min(len(ranges), 4 * n_tasks), "i").mapInArrow(add, "i int, rest binary, every binary")
    for r in summed.toLocalIterator(prefetchPartitions=True):
        if r["i"] == LESSON:
            taught(model, np.frombuffer(r["every"]))
            continue
        k, lo = ranges[r["i"]]
        for table, x in ((rest, r["rest"] or r["every"]), (every, r["every"])):
            part = np.frombuffer(x, np.int8)
            table[k][lo : lo + len(part)] = part
    return rest, every


def triple_counts(docs: DataFrame) -> np.ndarray:
    """How often each symbol follows each two bytes in docs (column text)."""

    def count(batches):
        total = np.zeros(257**3, np.uint32)
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in parts_of(texts):
                raw = [bytes_of(texts[k]) for k in part]
                size = np.array([len(t) + 1 for t in raw])
                s = np.frombuffer(b"\0".join([*raw, b""]), np.uint8).astype(np.intp)
                s[np.cumsum(size) - 1] = END
                first = np.cumsum(size) - size
                last = np.append(START, s[:-1])
                last[first] = START
                two = np.append(START, last[:-1])
                two[first] = START
                np.add.at(total, (two * 257 + last) * 257 + s, np.uint32(1))
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["triple", "n"])

    out = np.zeros(257**3, np.int64)
    for b in docs.mapInArrow(trimmed(count), "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).toLocalIterator():
        out[b["triple"]] = b["n"]
    return out


def fit(train: DataFrame, n_bytes: int, n_rows: int) -> Model:
    """A model of the training rows (text): trees, counts, weights and refining table come from all of them."""
    code, sizes = Code(triple_counts(train.select("text"))), table_sizes(int(n_bytes))
    # Few rows go to few tasks: a task learns weights by the counts of its own rows.
    n_tasks = max(min(2 * train.sparkSession.sparkContext.defaultParallelism, 1 + n_rows // TASK_ROWS), int(n_bytes) // (8 * sum(sizes)))
    model = Model(code, [])
    _, model.tables = tables_of(train.select("text", F.lit(False).alias("sample")), code, sizes, n_tasks, model)
    return model


END_WORD = np.array([0xE5D0E5D0E5D0E5D0], np.uint64)


def tokens_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts, the end of each among them, and which text each is of."""
    words, of = words_in([bytes_of(t) for t in texts])
    return np.concatenate([words, np.repeat(END_WORD, len(texts))]), np.concatenate([of, np.arange(len(texts))])


def _gathered(arrays, most: int = 1_000_000):
    """Arrays joined to about that length."""
    held, n = [], 0
    for x in arrays:
        held.append(x)
        n += len(x)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def vocabulary(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(word, n): the words of docs (column text) by hash, with their counts; a table."""

    def count(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for found in _gathered(tokens_in([texts[k] for k in ks])[0] for ks in parts_of(texts)):
                word, n = np.unique(found, return_counts=True)
                bucket = (word % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                rows = [(i, word[order[x:y]].tobytes() + n[order[x:y]].astype(np.uint32).tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    def add(batches):
        held: dict[int, list] = {}

        def merged(parts):
            word, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return word, np.bincount(at, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = len(x) // 12
                parts = held.setdefault(i, [])
                parts.append((np.frombuffer(x, np.uint64, k), np.frombuffer(x, np.uint32, k, 8 * k)))
                if len(parts) > 48:
                    held[i] = [merged(parts)]
        for i, parts in held.items():
            word, n = merged(parts)
            for a in range(0, len(word), 100_000):
                c = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word[c]), i, np.int32)), pa.array(word[c].view(np.int64)), pa.array(n[c])], names=["bucket", "word", "n"])

    return written(docs.mapInArrow(trimmed(count), "bucket int, blob binary").repartition(n_buckets, "bucket").mapInArrow(trimmed(add), "bucket int, word long, n long"), "vocabulary")


def word_scores(docs: DataFrame, vocab: DataFrame, n_buckets: int) -> DataFrame:
    """h1, h2 (hashes of the text), n_tokens, n_known, log_sum (of log10(c + 1) over tokens) for each
    distinct text. docs: h1, h2, text."""
    spark = docs.sparkSession
    # The least count of the hot words, from a bounded top list.
    top = vocab.orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", "n").toPandas()
    hot_word = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_word)
    hot = spark.sparkContext.broadcast((hot_word[order], top["n"].to_numpy(np.int64)[order]))
    kind = "bucket int, part long, blob binary"

    def ask(batches):
        hw, hn = hot.value
        for b in batches:
            every = b.column(2).to_pylist()
            for ks in parts_of(every, 3_000_000):
                part = b.slice(ks[0], len(ks))
                ids, hs, texts = (c.to_pylist() for c in part.columns)
                found = [tokens_in([texts[k] for k in run]) for run in parts_of(texts)]
                first = np.cumsum([0, *(int(d[-1]) + 1 for _, d in found)])
                word, doc = np.concatenate([w for w, _ in found]), np.concatenate([d + f for (_, d), f in zip(found, first[:-1], strict=True)])
                # Sorted by word, and so by document within a word: a run is a word of a document.
                order = np.lexsort((doc, word))
                word, doc = word[order], doc[order]
                new_word = np.append(True, word[1:] != word[:-1])
                at = np.flatnonzero(new_word | np.append(True, doc[1:] != doc[:-1]))
                tokens, tf = np.bincount(doc, minlength=len(ids)), np.diff(np.append(at, len(word)))
                word, doc, rank = word[at], doc[at], np.cumsum(new_word[at]) - 1
                distinct = word[new_word[at]]
                place = np.minimum(np.searchsorted(hw, distinct), max(0, len(hw) - 1))
                known = hw[place] == distinct if len(hw) else np.zeros(len(distinct), bool)
                hit, logs = known[rank], (np.log10(hn[place] + 1.0) if len(hw) else np.zeros(len(distinct)))[rank]
                own = np.stack([tokens, np.bincount(doc[hit], tf[hit], len(ids)), np.bincount(doc[hit], tf[hit] * logs[hit], len(ids))], 1)
                word, doc, tf = word[~hit], doc[~hit].astype(np.uint16), tf[~hit].astype(np.uint32)
                bucket = (word % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket.astype(np.int16) if n_buckets < 32_000 else bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                idb = np.array(ids, np.int64)
                hb = np.array(hs, np.int64)
                rows = []
                for i in range(n_buckets):
                    o = order[cuts[i] : cuts[i + 1]]
                    if len(o):
                        w, first = np.unique(word[o], return_index=True)
                        present, at = np.unique(doc[o], return_inverse=True)
                        head = np.array([len(present), len(w), len(o)], np.int64)
                        rows.append((i, b"".join(x.tobytes() for x in (head, idb[present], hb[present], w, np.diff(np.append(first, len(o))).astype(np.uint16), at.astype(np.uint16), tf[o]))))
                # A part's replies meet again under a number made of its contents: a task run anew gives the same.
                number = int.from_bytes(hashlib.blake2b(idb.tobytes() + hb.tobytes(), digest_size=8).digest(), "little", signed=True)
                cols = np.array(own, np.float64).T
                whole = b"".join(x.tobytes() for x in (np.array([len(ids)], np.int64), idb, hb, cols[0].astype(np.int64), cols[1].astype(np.int64), cols[2]))
                rows.append((number % n_buckets, b"own" + whole))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] if r[1][:3] == b"own" else b"ask" + r[1] for r in rows], pa.binary())], names=["bucket", "part", "blob"])

    def answer(left, right):
        """left: requests of one bucket; right: its words. A reply has the same form as a part's own figures."""
        word = right["word"].to_numpy().view(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        n = right["n"].to_numpy() if right.num_rows else np.zeros(0, np.int64)
        order = np.argsort(word)
        word, n = word[order], n[order]
        parts, blobs = [], []
        for part, x in zip(left["part"].to_pylist(), left["blob"].to_pylist(), strict=True):
            kind_, x = x[:3], x[3:]
            if kind_ == b"own":
                parts.append(part)
                blobs.append(x)
                continue
            docs_n, words_n, pairs = (int(v) for v in np.frombuffer(x, np.int64, 3))
            at, got = 24, []
            for t, size in ((np.int64, docs_n), (np.int64, docs_n), (np.uint64, words_n), (np.uint16, words_n), (np.uint16, pairs), (np.uint32, pairs)):
                got.append(np.frombuffer(x, t, size, at))
                at += got[-1].nbytes
            ids, hs, w, reps, doc, tf = got
            p = np.minimum(np.searchsorted(word, w), max(0, len(word) - 1))
            c = np.repeat(np.where(word[p] == w, n[p], 0) if len(word) else np.zeros(len(w), np.int64), reps)
            known, total = np.bincount(doc, tf * (c > 0), docs_n).astype(np.int64), np.bincount(doc, tf * np.log10(c + 1.0), docs_n)
            parts.append(part)
            blobs.append(b"".join(v.tobytes() for v in (np.array([docs_n], np.int64), ids, hs, np.zeros(docs_n, np.int64), known, total)))
        return pa.table([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def united(batches):
        """The figures of each document, summed over its part's replies."""
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(x)
        for blobs in held.values():
            cols = []
            for x in sorted(blobs):
                k = int(np.frombuffer(x, np.int64, 1)[0])
                cols.append([np.frombuffer(x, t, k, 8 + 8 * k * i) for i, t in enumerate((np.int64,) * 4 + (np.float64,))])
            ids, hs, tokens, known, total = (np.concatenate(c) for c in zip(*cols, strict=True))
            keys = np.stack([ids, hs], 1)
            unique, at = np.unique(keys, axis=0, return_inverse=True)
            at = at.ravel()
            # A row that a part has twice asked twice: each answer counts once.
            times = np.maximum(1, np.bincount(at, tokens > 0, len(unique)))
            add = lambda v: np.bincount(at, v, len(unique)) / times
            yield pa.RecordBatch.from_arrays([pa.array(unique[:, 0]), pa.array(unique[:, 1]), pa.array(np.round(add(tokens)).astype(np.int64)), pa.array(np.round(add(known)).astype(np.int64)), pa.array(add(total))], names=["h1", "h2", "n_tokens", "n_known", "log_sum"])

    asked = docs.select("h1", "h2", "text").mapInArrow(trimmed(ask), kind).repartition(n_buckets, "bucket")
    got = asked.groupBy("bucket").cogroup(vocab.groupBy("bucket")).applyInArrow(lambda a, b: answer(a, b), "part long, blob binary")
    rows = got.repartition(n_buckets, "part").mapInArrow(trimmed(united), "h1 long, h2 long, n_tokens long, n_known long, log_sum double")
    return rows.groupBy("h1", "h2").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("log_sum").alias("log_sum"))


def model_scores(docs: DataFrame, model: Model) -> DataFrame:
    """id, h1, h2, bits and n_bytes of every row (columns id, h1, h2, text): one reading, no shuffle of texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(3).to_pylist()
            bits = np.zeros(len(texts))
            for mine in side_by_side(texts):
                bits[mine] = held.value.bits([texts[k] for k in mine])
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits), pa.array(size, pa.int64())], names=["id", "h1", "h2", "bits", "n_bytes"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "h1", "h2", "text").mapInArrow(trimmed(run), f"id {kind}, h1 long, h2 long, bits double, n_bytes long")


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) and
    bits_per_byte. train: the condition that training rows meet; a null counts as met."""
    ship(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(doc_id).alias("id"), whole.alias("text"), F.coalesce(train, F.lit(True)).alias("train"), F.xxhash64(F.lit(1), whole).alias("h1"), F.xxhash64(F.lit(2), whole).alias("h2"))
    taught = docs.filter("train").select("h1", "text")
    size, n_bytes, n_rows = docs.agg(F.sum(F.octet_length("text")), F.sum(F.when(F.col("train"), F.octet_length("text"))), F.count_if("train")).first()
    n_buckets = max(1, -(-(size or 0) // WORD_BUCKET_BYTES))
    vocab = vocabulary(taught.select("text"), n_buckets)
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = fit(taught, n_bytes or 0, n_rows)
    words = written(word_scores(docs, vocab, n_buckets), "words")
    forget(vocab)
    scored = model_scores(docs, model).join(words, ["h1", "h2"])
    return scored.select(
        F.col("id").alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / F.nullif(F.col("n_bytes"), F.lit(0))).alias("bits_per_byte"),
    )
