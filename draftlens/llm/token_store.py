"""Token-ID files: one zstandard frame per document, a document index and a seek table.

A shard is a valid .zst file:

    frame of document 0 | frame of document 1 | ... | index | seek table

A frame holds the document's ids as little-endian unsigned 32-bit integers. The index is a
skippable frame with an Arrow stream of (doc_id, n_tokens). The seek table is the public
seekable-format one: compressed and raw size and checksum (low half of XXH64 of the raw
bytes) of each frame, in a skippable frame at the file's end. A reader fetches the table,
then just the byte ranges of the documents it wants.

Shards hold ascending doc_id ranges. Tasks name their files freely and report them; only what
a successful attempt reported is in the manifest, so lost or repeated tasks leave no trace in
the result. Files go through pyarrow's filesystems to the shared folder.

Defined results: a null text is empty and gives the end id alone; ids may be of any type that has an
order, a null doc_id comes first; equal doc_ids are ordered by text; an empty table gives no shards and no rows. Other columns
are not stored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import batches_of, kept, new_path, trimmed, written

OPERATOR = "token_store"
END_ID = 2
SHARD_BYTES = 32_000_000  # of text
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CACHE_PIECES, CACHE_ONCE = 600_000, 250_000  # pieces whose ids are kept, and those of them met in one batch only
TOGETHER, BATCH_ROWS = 16_000, 1000  # pieces encoded as one text; rows that a worker holds
#: White space inside a piece (a newline is only at its start), so that its ends aren't sure to be cuts.
_UNSURE = re.compile(r"[^\S \n]")



class Encoder:
    """Ids of whole texts as bytes.

    The vocabulary's splitting pattern never joins characters across a single space or newline
    between two others, so a text's ids are those of its led pieces one after the other; pieces
    recur, and their ids are kept. It also parts letters from a full stop or comma after them.
    Where white space is of another shape, the library gets the whole text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.once: set[str] = set()
        n = self.tok.get_vocab_size(with_added_tokens=True)
        self.widths = np.zeros(n, np.int64)  # bytes per id: byte-level tokens have a character for each byte
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.widths[i] = len(token)
        self.marks = dict(zip(".,", self.library([".", ","]), strict=True))

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, new: list[str]) -> list[bytes]:
        """The ids of space- or newline-led pieces, encoded as one text and cut at their byte lengths."""
        whole = (" " + " ".join(new)).replace(" \n", "\n")
        ids = np.array(self.tok.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.widths[ids])
        # Pieces have a space or newline at their start, and none after it.
        text = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        stops = np.append(np.flatnonzero((text == 32) | (text == 10))[1:], len(text))
        at = np.searchsorted(ends, stops)
        if (at >= len(ids)).any() or (ends[at] != stops).any():
            return self.library([p if p[0] == "\n" else " " + p for p in new])
        raw, at = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, new: set[str]) -> None:
        """Adds pieces; those that hold white space of another shape get None."""
        kept = self.kept
        unsure, joined = new & {"", "\n"}, " ".join(new)
        for m in _UNSURE.finditer(joined):
            unsure.add(joined[joined.rfind(" ", 0, m.start()) + 1 : joined.find(" ", m.start()) % (len(joined) + 1)])
        kept.update(dict.fromkeys(unsure))
        sure = new - unsure
        tails = [p for p in sure if p[-1] in ".," and p[-2:-1].isalpha()]
        sure.difference_update(tails)
        sure.update(p for p in {p[:-1] for p in tails} if kept.get(p) is None)
        plain = list(sure)
        for lo in range(0, len(plain), TOGETHER):
            part = plain[lo : lo + TOGETHER]
            kept.update(zip(part, self.pieces(part), strict=True))
        for p in tails:
            kept[p] = kept[p[:-1]] + self.marks[p[-1]]

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        split = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        kept, pieces = self.kept, set().union(*split)
        if len(self.once) > CACHE_ONCE:  # most pieces never come again: those that did stay
            for p in self.once:
                del kept[p]
            self.once.clear()
        if len(kept) > CACHE_PIECES:
            kept.clear()
            self.once.clear()
        new = pieces.difference(kept)
        self.once -= pieces
        before = len(kept)
        self.learn(new)
        if len(kept) > before:
            self.once |= new
            self.once.update(p[:-1] for p in new if p[-1:] in ".," and p[:-1] in kept and p[:-1] not in pieces)
        out, other = [], []
        for k, x in enumerate(split):
            try:
                out.append(b"".join(map(kept.__getitem__, x))[4:])  # without the newline put in front
            except TypeError:  # a None among them
                other.append(k)
                out.append(b"")
        for k, ids in zip(other, self.library([texts[k] for k in other]), strict=True):
            out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    return kept(OPERATOR, path, lambda: Encoder(path))


def open_out(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(at, compression=None)


class Writer:
    """Writes one shard."""

    def __init__(self, out, kind: pa.DataType):
        import zstandard

        self.kind = kind
        self.out, self.zip = out, zstandard.ZstdCompressor(level=3)
        self.ids: list = []
        self.counts: list[int] = []
        self.table: list[bytes] = []

    def add(self, doc_id, ids: bytes) -> None:
        import xxhash

        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.table.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def close(self) -> None:
        batch = pa.record_batch([pa.array(self.ids, self.kind), pa.array(self.counts, pa.int64())], names=["doc_id", "n_tokens"])
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        index = sink.getvalue()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 8) + index + struct.pack("<Q", len(index) + 16))
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Reads a shard; documents are decompressed only as asked for."""

    def __init__(self, path: str):
        fs, at = pa.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        start = end - 9 - 12 * n
        self.table = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        (back,) = struct.unpack("<Q", self._at(start - 16, 8))
        index = pa.ipc.open_stream(self._at(start - 8 - back + 8, back - 16)).read_all()
        self.doc_ids, self.counts = index["doc_id"].combine_chunks(), index["n_tokens"].to_numpy()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def document(self, k: int) -> bytes:
        """The ids of the k-th document of the shard, as bytes; ValueError if they are damaged."""
        import xxhash
        import zstandard

        size, raw, check = self.table[k]
        ids = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(size)), max_output_size=max(1, int(raw)))
        if len(ids) != raw or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"document {self.doc_ids[k]}: checksum differs")
        return ids


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; returns the manifest, a table in the shared folder: shard, path, first_id and
    last_id, n_docs, n_ids."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The text's beginning splits an id that many rows share.
    dealt = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", F.substring("text", 1, 48)).sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", END_ID)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        path, out = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.zst", None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    out = out or Writer(open_out(path), b.schema.field(0).type)
                    out.add(i, ids + end)
        if out:
            out.close()
            columns = {"shard": pa.array([shard], pa.int32()), "path": pa.array([path]), "first_id": pa.array(out.ids[:1], out.kind), "last_id": pa.array(out.ids[-1:], out.kind), "n_docs": pa.array([len(out.ids)], pa.int64()), "n_ids": pa.array([sum(out.counts)], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    with batches_of(spark, BATCH_ROWS):
        return written(dealt.mapInArrow(trimmed(run, OPERATOR), f"shard int, path string, first_id {kind}, last_id {kind}, n_docs long, n_ids long"), "tokens-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. The manifest has a
    row for each shard; its running sum gives each shard's first position."""
    ship(spark)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    kind = manifest.schema["first_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = Reader(path)
                starts = start + np.concatenate([[0], np.cumsum(r.counts)])[:-1]
                for lo in range(0, len(r.doc_ids), 4096):
                    part = slice(lo, min(lo + 4096, len(r.doc_ids)))
                    crc = [zlib.crc32(r.document(k)) for k in range(part.start, part.stop)]
                    yield pa.RecordBatch.from_arrays(
                        [r.doc_ids[part], pa.array(starts[part], pa.int64()), pa.array(r.counts[part], pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.repartition(max(1, manifest.count())).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, doc_ids: list) -> dict:
    """The ids of a few documents, reading only the shards that may hold them, and there only their frames."""
    out = {}
    held = F.lit(False)
    for i in doc_ids:
        held = held | (F.col("first_id").isNull() if i is None else (F.coalesce(F.col("first_id") <= F.lit(i), F.lit(True)) & (F.col("last_id") >= F.lit(i))))
    wanted = set(doc_ids)
    for r in manifest.filter(held).select("path").toLocalIterator():
        reader = Reader(r["path"])
        for k, i in enumerate(reader.doc_ids.to_pylist()):
            if i in wanted:
                out[i] = np.frombuffer(reader.document(k), "<u4")
    return out
