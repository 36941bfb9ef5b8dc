"""Operator 8: packing documents into fixed-length sequences.

First-fit decreasing with a tournament tree of bin capacities, run independently
in randomised groups of documents.  A document longer than a sequence is cut into
whole sequences and a rest; all pieces of a document are packed in its group.
Groups are bounded in documents, so a task never needs more than one group's
piece lengths (not texts) in memory, and no group sees another.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import memory_returned, table, texts_of, written
from quire.llm.fragments import encoder, tokenizer_path
from quire.llm.words import slices

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
#: Documents of a group, about.
GROUP_DOCS = 4096
#: Bytes of texts that a task encodes at once, one text at least.
ENCODED_BYTES = 1 << 20

PIECES = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: full sequences and one rest.

    A null or empty text has only the end id.  ``row_key`` sets the group: a hash
    of the id and the text, so rows with a null or repeated ``doc_id`` spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_returned()
        enc = encoder(path, "words")
        for batch in batches:
            yield from pieces_of(batch, enc.encode, length, end_id)
        memory_returned()

    keyed = texts_of(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return keyed.mapInArrow(run, PIECES)


def pieces_of(batch: pa.RecordBatch, encode: Callable[[list[str]], list[np.ndarray]], length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """The pieces of rows ``doc_id, text, row_key``, encoded about ``ENCODED_BYTES`` at once."""
    for a, b in slices(batch.column(1), ENCODED_BYTES):
        doc, texts, key = (c.slice(a, b - a).to_pylist() for c in batch.columns)
        rows = []
        for d, k, ids in zip(doc, key, encode(texts)):
            raw = np.append(ids, end_id).astype("<u4")
            n = len(raw)
            for at in range(0, n, length):
                part = raw[at : at + length]
                rows.append((d, k, at, len(part), zlib.crc32(part.tobytes()), n))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"])


class Tournament:
    """Capacities of bins in a complete binary tree whose inner nodes hold maxima.

    ``first(size)`` finds the leftmost bin with room in O(log bins).
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        k = 1
        while k < self.leaves:
            k *= 2
            if self.room[k] < size:
                k += 1
        return k - self.leaves

    def take(self, at: int, size: int) -> int:
        """Puts ``size`` into a bin; returns the room it had before."""
        k = at + self.leaves
        before = self.room[k]
        self.room[k] = before - size
        while k > 1:
            k //= 2
            best = max(self.room[2 * k], self.room[2 * k + 1])
            if self.room[k] == best:
                break
            self.room[k] = best
        return before


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size; equal sizes keep their order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.first(sizes[i])
        bins[i], offsets[i] = at, capacity - tree.take(at, sizes[i])
    return bins, offsets


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 8) -> DataFrame:
    """Every piece with its sequence and its offset there.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  The
    same rows and seed give the same groups; pieces of equal size are ordered by
    document, start and checksum, so the result does not depend on partitioning.
    Null ids and repeated rows are packed like any other row; an empty table gives
    no pieces; other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "row_key", "start"], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), length)
        base = int(group["pack_group"].iloc[0]) << 32
        return group.assign(sequence_id=[base + b for b in bins], offset=offsets)[[c.split()[0] for c in PACKED.split(", ")]]

    dealt = written(pieces(docs, path, length, end_id), "pieces").withColumn("pack_group", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, in sequences of 4096."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
