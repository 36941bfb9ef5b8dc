"""Operator 10: token ids with Elias-Fano document boundaries.

Documents are laid out in ascending ``doc_id`` order as one concatenated id
array.  It is stored in bounded blocks; each holds its ids in the narrowest
unsigned type and the ends of its documents as an Elias-Fano sequence: the low
bits packed side by side, the high bits in unary, and samples of these, from which
``select`` finds a boundary.  The ascending document ids are such a sequence, too, so
no table of 64-bit numbers is kept.

Blocks are rows of a Parquet table (a binary column in the format below), so
that they can be written to and read from any store that Spark reaches and a
lost task is simply run again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import table, texts_of, work_path
from quire.llm.fragments import chunks, encoder, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids of a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
#: Bytes of text that one output task handles, about.
TASK_BYTES = 32 << 20
SAMPLE = 64
#: Parts whose sums are broadcast, at most.
BROADCAST_PARTS = 1_000_000

BLOCKS = "part int, block int, part_start long, n_docs int, n_ids long, doc_ids binary, data binary"


class EliasFano:
    """A non-decreasing sequence below ``universe`` in about ``2 + log2(u / n)`` bits each, and samples for ``select``."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        self.ones = ones  # ones up to the end of each run of SAMPLE bytes

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 1) // 8) if n else 0
        bitmap = np.zeros(8 * size, dtype=np.uint8)
        bitmap[at] = 1
        ones = np.searchsorted(at, 8 * np.arange(SAMPLE, size + 1, SAMPLE)).astype("<u4")
        return cls(n, universe, bits, np.packbits(low, bitorder="little"), np.packbits(bitmap, bitorder="little"), ones)

    def select(self, k: int) -> int:
        """The value at ``k``."""
        run = int(np.searchsorted(self.ones, k, side="right"))
        before = int(self.ones[run - 1]) if run else 0
        first = run * SAMPLE
        bits = np.unpackbits(self.high[first : first + SAMPLE], bitorder="little")
        at = first * 8 + int(np.flatnonzero(bits)[k - before])
        low = 0
        if self.low_bits:
            a = k * self.low_bits
            window = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8 + 1].tobytes(), "little")
            low = (window >> (a % 8)) & ((1 << self.low_bits) - 1)
        return ((at - k) << self.low_bits) | low

    def values(self) -> np.ndarray:
        """All values in order, as unsigned 64-bit integers."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.int64)
        out = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.universe - 1, self.low_bits) + struct.pack("<Q", len(self.high)) + self.ones.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, last, bits = cls.HEAD.unpack_from(raw)
        (size,) = struct.unpack_from("<Q", raw, cls.HEAD.size)
        at = cls.HEAD.size + 8
        ones = np.frombuffer(raw, "<u4", offset=at, count=size // SAMPLE)
        rest = np.frombuffer(raw, dtype=np.uint8, offset=at + ones.nbytes)
        cut = (n * bits + 7) // 8
        return cls(n, last + 1, bits, rest[:cut], rest[cut : cut + size], ones)


class Block:
    """One stretch of the id array with the ends of its documents."""

    HEAD = struct.Struct("<4sBQQ")

    def __init__(self, ends: EliasFano, ids: np.ndarray):
        self.ends, self.ids = ends, ids

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Block:
        ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
        ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
        return cls(EliasFano.of(ends, len(ids) + 1), ids.astype(f"<u{wide}"))

    def document(self, k: int) -> np.ndarray:
        """The ids of the block's document ``k``."""
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]

    def to_bytes(self) -> bytes:
        ends = self.ends.to_bytes()
        return self.HEAD.pack(b"QEF1", self.ids.itemsize, len(ends), len(self.ids)) + ends + self.ids.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Block:
        magic, wide, n, ids = cls.HEAD.unpack_from(raw)
        if magic != b"QEF1":
            raise ValueError("not a block of token ids")
        at = cls.HEAD.size
        return cls(EliasFano.from_bytes(raw[at : at + n]), np.frombuffer(raw, dtype=f"<u{wide}", offset=at + n, count=ids))


_NAMES = struct.Struct("<QqQ")


def names_to_bytes(ids: list[int | None]) -> bytes:
    """Ascending document ids, nulls first: the number of nulls, the least id, and Elias-Fano distances from it."""
    some = [i for i in ids if i is not None]
    base = some[0] if some else 0
    apart = np.array(some, dtype="<i8").view(np.uint64) - np.array([base], dtype="<i8").view(np.uint64)
    return _NAMES.pack(len(ids) - len(some), base, len(some)) + (EliasFano.of(apart, int(apart[-1]) + 1).to_bytes() if some else b"")


def names_from_bytes(raw: bytes) -> pa.Array:
    """The ids that :func:`names_to_bytes` wrote, as 64-bit integers."""
    nulls, base, n = _NAMES.unpack_from(raw)
    found = EliasFano.from_bytes(raw[_NAMES.size :]).values() + np.array([base], dtype="<i8").view(np.uint64) if n else np.zeros(0, np.uint64)
    return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(found.view(np.int64))])


def write(docs: DataFrame, out: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the token ids of every document to the folder ``out``.

    Documents are dealt by ranges of ``doc_id``, so parts and the blocks in them
    are in ascending order; nulls come first, rows with the same ``doc_id`` are
    ordered by text.  A null text counts as empty.  Other columns are ignored.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "forced")
        part = TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            n = sum(map(len, held))
            row = {"part": part, "block": state["block"], "part_start": state["start"], "n_docs": len(held), "n_ids": n, "doc_ids": names_to_bytes(names), "data": Block.of(held).to_bytes()}
            state["block"] += 1
            state["start"] += n
            held.clear()
            names.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("data", pa.binary())])
        size = 0
        for batch in batches:
            doc, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in chunks(texts):
                for d, ids in zip(doc[s], enc.encode(texts[s])):
                    if held and size + len(ids) + 1 > block_ids:
                        yield flush()
                        size = 0
                    held.append(np.append(ids, end_id).astype(np.uint32))
                    names.append(d)
                    size += len(ids) + 1
        if held:
            yield flush()

    rows = texts_of(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-size // TASK_BYTES)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Each document's place in the whole id array and its ids.

    ``doc_id, start long, ids array<int>``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.from_bytes(row["data"])
                ends = block.ends.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]) + row["first_id"] if len(ends) else ends
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(block.ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names_from_bytes(row["doc_ids"]), pa.array(starts, pa.int64()), lists], ["doc_id", "start", "ids"])

    return _placed(spark, out).mapInArrow(run, "doc_id long, start long, ids array<int>")


def _placed(spark: SparkSession, out: str) -> DataFrame:
    """The blocks with ``first_id``, the ids before them in the whole array: one sum for each part, in a window."""
    blocks = spark.read.schema(BLOCKS).parquet(out)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    first = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_first"))
    # 16 bytes a part; beyond the bound blocks and parts are shuffled
    placed = blocks.join(F.broadcast(first) if sums.count() <= BROADCAST_PARTS else first, "part")
    return placed.select("n_docs", "doc_ids", "data", (F.col("part_first") + F.col("part_start")).alias("first_id"))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.from_bytes(row["data"])
                edge = np.concatenate([[0], block.ends.values().astype(np.int64)])
                raw = memoryview(block.ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edge.tolist(), edge[1:].tolist())]
                cols = [names_from_bytes(row["doc_ids"]), pa.array(edge[:-1] + row["first_id"]), pa.array(np.diff(edge)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, out).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, written to the shared folder and read back."""
    out = work_path(spark, "ids")
    write(table(spark, sf_dir, "documents"), out, tokenizer_path(VOCABULARY))
    return digests(spark, out)
