"""Operator 7: substring dedup over suffix arrays.

A byte goes when a string of ``size`` bytes covers it that also starts in a
document of smaller id.  Equal strings have equal minimizers (the smallest hash
of their short substrings), so strings are dealt to shards by minimizer:

1. Each document names its minimizers; where they meet, those of one document only are
   left out, which leaves the repeated part of the corpus.
2. Maximal stretches whose strings share a minimizer become segments.  Segments
   that are equal as a whole are taken once, with their smallest document.
3. Segments of one minimizer meet in one shard.  Each shard sorts its suffixes by
   induced sorting with disk-backed queues (:mod:`quire.llm.induced`); neighbours
   with a common prefix of ``size`` bytes are the same string, and its smallest
   document is the least of theirs.  A minimizer with one distinct segment has no
   neighbours to look for.
4. Where a smaller document has the string, its bytes are removed.

Shards end between minimizers at about ``SHARD_BYTES``; a minimizer with more than
that is one shard, whose queues then spill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import discard, memory_returned, table, texts_of, written
from quire.llm.induced import LIMIT, induced_order
from quire.llm.words import mix, polynomial, slices, text_bytes

SIZE = 50
#: Bytes of the substrings whose smallest hash is the minimizer.
GRAM = 16
SHARD_BYTES = 3 << 18


def stretches(raw: np.ndarray, at: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first string (as a place in ``raw``), number of strings and text of each maximal stretch of the texts that begin at ``at``."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = polynomial(raw, gram)
    window = size - gram + 1
    step = 1
    while step < window:
        more = min(step, window - step)
        least = np.minimum(least[: len(least) - more], least[more:])
        step += more
    # strings lie within a text
    within = np.zeros(n + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(at) >= size)
    np.add.at(within, at[long], 1)
    np.add.at(within, at[long + 1] - size + 1, -1)
    within = np.cumsum(within[:-1]) > 0
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (within[1:] != within[:-1])
    new[at[long]] = True
    start = np.flatnonzero(new)
    count = np.diff(start, append=n)
    start, count = start[within[start]], count[within[start]]
    return least[start], start, count, np.searchsorted(at, start, side="right") - 1


def minimizers(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``minimizer long, doc_id long``, once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(1)):
                least, _, _, row = stretches(*text_bytes(batch.column(1).slice(a, b - a)), size, gram)
                order = np.lexsort((least, row))
                least, row = least[order], row[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(doc[a:b][row[new]])], ["minimizer", "doc_id"])
        memory_returned()

    return docs.mapInArrow(run, "minimizer long, doc_id long")


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``minimizer, doc_id`` that are ordered by minimizer, those whose minimizer several documents have."""
    names = ["minimizer", "doc_id"]
    held: tuple[int, int, int] | None = None  # the last minimizer, which may go on, its smallest and its largest document
    for batch in batches:
        if not batch.num_rows:
            continue
        minimizer, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        first = np.flatnonzero(np.concatenate([[True], minimizer[1:] != minimizer[:-1]]))
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        if held and held[0] == minimizer[0]:
            low[0], high[0] = min(low[0], held[1]), max(high[0], held[2])
            # until now it had one document, so one row stands for those left out
            if held[1] == held[2] and low[0] != high[0]:
                yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names)
        on = np.repeat(low != high, np.diff(first, append=len(doc)))
        held = (int(minimizer[-1]), int(low[-1]), int(high[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(minimizer[on]), pa.array(doc[on])], names)


SEGMENTS = "minimizer long, segment_hash long, doc_id long, text_hash long, start int, strings int, segment binary"


def segments(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """The segments of ``doc_id, text, text_hash, shared array<long>`` with a shared minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for a, b in slices(batch.column(1)):
                raw, at = text_bytes(batch.column(1).slice(a, b - a))
                least, start, n, row = stretches(raw, at, size, gram)
                edges = np.searchsorted(row, np.arange(b - a + 1))
                on = np.zeros(len(row), dtype=bool)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    shared = np.sort(batch.column(3)[a + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    part = slice(edges[k], edges[k + 1])
                    if len(shared):
                        on[part] = shared[np.minimum(np.searchsorted(shared, least[part]), len(shared) - 1)] == least[part]
                least, start, n, row = least[on], start[on], n[on], row[on]
                if not len(row):
                    continue
                length = n + size - 1
                ends = np.concatenate([[0], np.cumsum(length)])
                letters = raw[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
                cols = (least.view(np.int64), digests(raw, start, length).view(np.int64), doc[a:b][row], of[a:b][row], (start - at[row]).astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), binary], [c.split()[0] for c in SEGMENTS.split(", ")])
        memory_returned()

    return docs.select("doc_id", "text", "text_hash", "shared").mapInArrow(run, SEGMENTS)


def digests(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of eight bytes or more: the mixed sum of its eight-byte words, each mixed with its place."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    n = -(-length // 8)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    # the last word may lie over the one before it
    word = eight[np.repeat(start, n) + np.minimum(8 * place, np.repeat(length - 8, n))]
    sums = np.add.reduceat(mix(word + mix((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), first)
    return mix(sums + length.astype(np.uint64))


def string_owners(data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, size: int, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that a segment of a smaller owner has too: their segment, first string and number, in order.

    ``data``: the bytes of all segments, end to end.
    """
    n = len(lengths)
    start = np.cumsum(lengths + 1) - lengths - 1
    at = np.arange(len(data)) + np.repeat(np.arange(n), lengths)
    raw = np.zeros(len(data) + n + 7, dtype=np.uint8)
    raw[at] = data
    text = np.ones(len(data) + n, dtype=np.uint16)
    text[at] = data.astype(np.uint16) + 2
    text[-1] = 0
    del at
    valid = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(valid, start, 1)
    np.add.at(valid, start + lengths - size + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    of = np.repeat(np.arange(n, dtype=np.int32), lengths + 1)
    order = induced_order(text, size, limit)
    order = order[inside[order]]
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    same = np.ones(len(order) - 1, dtype=bool)
    for k in sorted({*range(0, size - 7, 8), max(0, size - 8)}):
        some = np.flatnonzero(same)
        same[some] = eight[order[some] + k] == eight[order[some + 1] + k]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(owner[of[order]], first)
    smaller = np.zeros(len(text) + 2, dtype=np.int8)
    smaller[order + 1] = np.repeat(least, np.diff(first, append=len(order))) < owner[of[order]]
    edge = np.diff(smaller)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return of[a], a - start[of[a]], b - a


def resolved(distinct: DataFrame, size: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``minimizer, segment_hash, owner, starts, lengths``: strings of each segment that a smaller document has.

    ``distinct``: ``minimizer, segment_hash, owner, segment``; places are strings within the segment.
    """
    schema = "minimizer long, segment_hash long, owner long, starts array<int>, lengths array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # minimizer, hash, owner, length; and the bytes
        held_bytes = 0

        def shard() -> pa.RecordBatch:
            minimizer, digest, owner, length, data = (np.concatenate(c) for c in zip(*held))
            of, start, n = string_owners(data, length, owner, size)
            ends = pa.array(np.searchsorted(of, np.arange(len(owner) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int32())) for c in (start, n)]
            return pa.RecordBatch.from_arrays([pa.array(minimizer), pa.array(digest), pa.array(owner), *lists], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            minimizer = batch.column(0).to_numpy(zero_copy_only=False)
            # a minimizer with one segment has nothing to compare; the batch's first and last may have more elsewhere
            alone = np.zeros(len(minimizer), dtype=bool)
            alone[1:-1] = (minimizer[1:-1] != minimizer[:-2]) & (minimizer[1:-1] != minimizer[2:])
            if alone.any():
                rest = batch.select(names[:3]).filter(pa.array(alone))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(rest.num_rows + 1), pa.int32()), pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([*rest.columns, none, none], names)
                batch = batch.filter(pa.array(~alone))
            minimizer, digest, owner = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            data, at = text_bytes(batch.column(3))
            # the batch's last minimizer may go on in the next
            last = int(np.flatnonzero(minimizer != minimizer[-1])[-1]) + 1 if minimizer[0] != minimizer[-1] else 0
            if held_bytes + at[last] > shard_bytes and (last or (held and held[-1][0][-1] != minimizer[0])):
                if last:
                    held.append([minimizer[:last], digest[:last], owner[:last], np.diff(at[: last + 1]), data[: at[last]]])
                yield shard()
                held, held_bytes = [], 0
            else:
                last = 0
            held.append([minimizer[last:].copy(), digest[last:].copy(), owner[last:].copy(), np.diff(at[last:]), data[at[last] :].copy()])
            held_bytes += int(at[-1] - at[last])
        if held:
            yield shard()
        held = []
        memory_returned()

    dealt = distinct.select("minimizer", "segment_hash", "owner", "segment").repartition("minimizer").sortWithinPartitions("minimizer")
    return dealt.mapInArrow(run, schema)


def removed_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, spans array<struct<start,length>>`` of bytes to remove; they may overlap.

    ``docs``: ``doc_id, text, text_hash`` without null ids.
    """
    found = minimizers(docs, size, gram).repartition("minimizer").sortWithinPartitions("minimizer")
    named = found.mapInArrow(repeated, "minimizer long, doc_id long").groupBy("doc_id").agg(F.collect_list("minimizer").alias("shared"))
    named = written(named, "named")
    placed = written(segments(docs.join(named, "doc_id"), size, gram), "segments")
    discard(named)
    # in two parts, which halves the disk space of the shuffle
    halves = [placed.filter(F.pmod(F.xxhash64("minimizer"), F.lit(2)) == half) for half in (0, 1)]
    halves = [written(h.groupBy("minimizer", "segment_hash").agg(F.min("doc_id").alias("owner"), F.first("segment").alias("segment")), "distinct") for h in halves]
    distinct = halves[0].unionByName(halves[1])
    owners = written(resolved(distinct, size), "owners")
    for half in halves:
        discard(half)
    joined = placed.drop("segment").join(owners, ["minimizer", "segment_hash"])
    whole = F.array(F.struct(F.lit(0).alias("starts"), F.col("strings").alias("lengths")))
    runs = F.when(F.col("doc_id") != F.col("owner"), whole).otherwise(F.arrays_zip("starts", "lengths"))
    found = joined.select("doc_id", "text_hash", "start", F.explode(runs).alias("p"))
    found = found.select("doc_id", "text_hash", (F.col("start") + F.col("p.starts")).alias("start"), (F.col("p.lengths") + size - 1).alias("length"))
    spans = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    spans = written(spans, "spans")
    discard(placed)
    discard(owners)
    return spans


def merged(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the union of each row's spans ``(start, length)``, and where each row's begin; spans that touch are one."""
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "length"))
    order = np.lexsort((start, row))
    row, start, length = row[order], start[order], length[order]
    # rows one after the other, so that none reaches into the next
    end = np.maximum.accumulate(start + length + (row << 32)) - (row << 32)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return start[first], end[last], np.searchsorted(row[first], np.arange(len(spans) + 1))


def deduplicated(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary``, one row per document.

    Texts are UTF-8 bytes, a null text is empty; what is kept may end inside a
    character.  Rows with a null ``doc_id`` keep all their bytes and take none from
    others; rows with the same id take none from each other, each is judged by
    itself; an empty table gives no rows; other columns are ignored.
    """
    docs = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    spans = removed_spans(docs.filter(F.col("doc_id").isNotNull()), size, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            raw, at = text_bytes(batch.column(1))
            begins, ends, of = merged(batch.column(2))
            for k in range(batch.num_rows):
                text = raw[at[k] : at[k + 1]]
                a, b = begins[of[k] : of[k + 1]], ends[of[k] : of[k + 1]]
                edges = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), len(text)]
                kept = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(text), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        memory_returned()

    joined = docs.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: strings of 50 bytes over all documents."""
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
