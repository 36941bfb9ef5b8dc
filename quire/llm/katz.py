"""Operator 5: language-model scores by Katz backoff.

An n-gram model (:data:`ORDER` words) with Good-Turing discounts.  A token that its
context was seen with has its discounted relative frequency; any other has the
context's backoff weight times its own probability one order lower, and so on down to
single words, where unseen words share what the discounts leave.  The weight is what
the context's discounts leave, divided by the lower-order probability of all words not
seen there, so that each context's probabilities sum to one over the vocabulary and
one unknown word.

Counts grow with the corpus and are never gathered in one place:

* Texts become chunks of token numbers with a vocabulary each, written once.
* Words are dealt by hash; each bucket adds up the chunks' counts and tells every
  chunk those of its own words.
* Then order by order, each chunk asks for its distinct n-grams, with its training
  counts and the probabilities of the order below.  They are dealt by context, so that a
  bucket has all of a context's counts and what its weight divides by, and answers every
  chunk.  The counts-of-counts of all buckets give the order's discounts, with which
  the chunks turn answers into probabilities, which the next order asks with.
  Contexts with more than ``HOT`` of all tokens, so at most ``1 / HOT`` of each order,
  are spread by n-gram; the buckets' sums for them are added up and broadcast.

What is dealt travels as arrays in few rows; an order goes in ``ROUNDS`` parts, one
after the other, to bound the disk space of a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import discard, memory_returned, table, texts_of, written
from quire.llm.words import mix, slices, text_bytes, words

END, START = np.uint64(0x0E4D), np.uint64(0x57A7)
#: Good-Turing discounts apply to counts up to this one.
CUTOFF = 5
#: Words of the longest n-grams that the query's model has.
ORDER = 3
#: Share of all training tokens above which a context is frequent.
HOT = 1 / 1000
ROUNDS = 5
#: Tokens of a chunk and of a bucket, about.
CHUNK, BUCKET = 1 << 20, 1 << 21
#: Chunks that Python gets at once.
CHUNK_ROWS = 4

CHUNKS = "chunk long, docs binary, held binary, lengths binary, vocabulary binary, tokens binary"


def discounts(counts_of: list[int]) -> list[float]:
    """Good-Turing discounts of counts 1 to ``CUTOFF``; ``counts_of[r]``: how many have count r.

    Where the formula gives nothing between 0 and 1, half a count is taken off.
    """
    n, k = counts_of, CUTOFF
    out = [1.0]
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Lower:
    """Probabilities of single words: discounted, the rest for the unknown word."""

    def __init__(self, total: int, types: int, counts_of: list[int]):
        self.total, self.types, self.d = total, types, np.array(discounts(counts_of))
        left = sum(counts_of[r] * r * (1 - self.d[r]) for r in range(1, CUTOFF + 1))
        if not total:
            self.over, self.unknown = 1.0, 1.0
        elif left > 0:
            self.over, self.unknown = float(total), left / total
        else:
            self.over, self.unknown = total + 1.0, 1 / (total + 1)

    def probability(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(np.float64)
        d = np.where(count <= CUTOFF, self.d[np.minimum(count, CUTOFF)], 1.0)
        return np.where(count > 0, d * c / self.over, self.unknown)


def chunks(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, held)`` as rows of :data:`CHUNKS`; every text ends with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, nulls, out, lengths, tokens = (np.concatenate(c) for c in zip(*held))
            vocabulary, numbers = np.unique(tokens, return_inverse=True)
            docs_of = np.packbits(nulls).tobytes() + ids.astype("<i8").tobytes()
            blobs = [docs_of, out.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), vocabulary.astype("<u8").tobytes(), numbers.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | n], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], [c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashes, rows = words(*text_bytes(batch.column(1).slice(a, b - a)))
                count = np.bincount(rows, minlength=b - a)
                tokens = np.empty(len(hashes) + b - a, dtype=np.uint64)
                ends = np.cumsum(count + 1) - 1
                tokens[ends] = END
                inner = np.ones(len(tokens), dtype=bool)
                inner[ends] = False
                tokens[inner] = hashes
                ids = batch.column(0).slice(a, b - a)
                held.append((ids.fill_null(0).to_numpy(), np.array(ids.is_null()), batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False), count + 1, tokens))
                size += len(tokens)
                if size >= CHUNK:
                    yield row()
                    held, size, n = [], 0, n + 1
        if held:
            yield row()
        held = []
        memory_returned()

    return docs.mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's arrays, and its tokens with the tokens before them."""

    def __init__(self, row: dict):
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        n = len(self.lengths)
        cut = (n + 7) // 8
        self.nulls = np.unpackbits(np.frombuffer(row["docs"], np.uint8, count=cut))[:n].astype(bool)
        self.ids = np.frombuffer(row["docs"], "<i8", offset=cut, count=n)
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.tokens = np.frombuffer(row["tokens"], "<u4")
        self.learned = np.repeat(~self.held, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        if row.get("counts") is not None:
            self.counts = np.frombuffer(row["counts"], "<i8")
        self.below = np.frombuffer(row["low"], "<f8") if row.get("low") is not None else None

    def low(self, lower: Lower, at: np.ndarray) -> np.ndarray:
        """The probabilities of some tokens, one order below the one that is asked for."""
        return lower.probability(self.counts[self.tokens[at]]) if self.below is None else self.below[at]

    @property
    def doc(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def part(self, part: int, parts: int) -> np.ndarray:
        """The tokens that follow one part of all words (the first ones follow the start)."""
        of = ((mix(np.append(self.vocabulary, START)) >> np.uint64(40)) % np.uint64(parts) == part)
        on = np.empty(len(self.tokens), dtype=bool)
        on[1:] = of[self.tokens[:-1]]
        on[self.first] = of[-1]
        return np.flatnonzero(on)

    def grams(self, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of some tokens' contexts of ``order - 1`` tokens, and of each with its token."""
        place = at - np.repeat(self.first, self.lengths)[at]
        for n in range(2, order + 1):
            back = order - n + 1
            word = self.vocabulary[self.tokens[np.maximum(at - back, 0)]]
            context = np.where(place >= back, word if n == 2 else gram_key(context, word), start_of(n))
        return context, gram_key(context, self.vocabulary[self.tokens[at]])


def gram_key(context: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hash of an n-gram; it is the context's hash one order higher."""
    return mix(context * np.uint64(0x9FB21C651E98DF25) + mix(own))


def start_of(order: int) -> np.uint64:
    """The context of a text's first token."""
    start = np.array([START])
    for _ in range(order - 2):
        start = gram_key(start, np.array([START]))
    return start[0]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; that size comes first."""
    most = int(values.max(initial=0))
    size = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64) for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """``(bucket, blobs...)`` for each bucket; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    columns = tuple(c[order] for c in columns)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if b > a:
            yield (int(bucket[a]), *(c[a:b].tobytes() for c in columns))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    names = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)], [n for n, _ in names])


def _joined(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def word_counts(encoded: DataFrame, buckets: int) -> DataFrame:
    """``chunk, words binary, counts binary, total, types, n1..`` by bucket: training counts of each chunk's words.

    The last columns repeat the bucket's own sums on the row of its first chunk.
    """
    sent = "bucket int, chunk long, words binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                counts = np.bincount(c.tokens[c.learned], minlength=len(c.vocabulary)).astype("<i8")
                bucket = (mix(c.vocabulary) % np.uint64(buckets)).astype(np.int64)
                yield _rows(sent, [(b, row["chunk"], w, n) for b, w, n in _dealt(bucket, c.vocabulary, counts)])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        all_words, counts = _joined(group["words"], "<u8"), _joined(group["counts"], "<i8")
        known, at = np.unique(all_words, return_inverse=True)
        total = np.zeros(len(known), dtype=np.int64)
        np.add.at(total, at, counts)
        seen = total[total > 0]
        sums = [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()]
        edge = np.concatenate([[0], np.cumsum([len(w) // 8 for w in group["words"]])])
        told = [total[at[a:b]].astype("<i8").tobytes() for a, b in zip(edge, edge[1:])]
        own = [sums] + [[0] * len(sums)] * (len(group) - 1)
        return pd.DataFrame({"chunk": group["chunk"], "words": group["words"], "counts": told, "sums": own})

    return encoded.mapInArrow(send, sent).groupBy("bucket").applyInPandas(add, "chunk long, words binary, counts binary, sums array<long>")


def annotated(encoded: DataFrame, counted: DataFrame) -> DataFrame:
    """The chunks with ``counts binary``: training counts in the order of their vocabularies."""
    told = counted.groupBy("chunk").agg(F.collect_list(F.struct("words", "counts")).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                found, counts = _joined([t["words"] for t in row["told"]], "<u8"), _joined([t["counts"] for t in row["told"]], "<i8")
                blob = counts[np.argsort(found, kind="stable")].tobytes()  # vocabularies are sorted
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(6)), pa.array([blob], pa.binary())], [*(c.split()[0] for c in CHUNKS.split(", ")), "counts"])
        memory_returned()

    return encoded.join(told, "chunk").mapInArrow(run, CHUNKS + ", counts binary")


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys follow each other, and where each key begins there."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _place(hot: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are frequent, and where they stand in ``hot``."""
    if not len(hot):
        return np.zeros(len(context), bool), np.zeros(len(context), np.int64)
    place = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
    return hot[place] == context, place


class Requests:
    """A chunk's distinct n-grams of one part of all contexts, by bucket."""

    def __init__(self, c: Chunk, order_of: int, hot: np.ndarray, buckets: int, part: int, parts: int):
        mine = c.part(part, parts)
        context, key = c.grams(mine, order_of)
        order, at = _groups(key)
        context, key = context[order[at]], key[order[at]]
        order, at = order.astype(np.int32), at.astype(np.int32)
        self.hot, self.place = _place(hot, context)
        dealt_by = np.where(self.hot, key, context)
        bucket = (mix(dealt_by ^ np.uint64(7)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        by = np.argsort(bucket, kind="stable").astype(np.int32)
        #: Tokens by n-gram, where each n-gram begins, and the n-grams by bucket with a token of each.
        self.tokens, self.at, self.by = mine.astype(np.int32)[order], at, by
        self.first, self.context, self.key = self.tokens[at][by], context[by], key[by]
        self.bucket, self.hot, self.place = bucket[by].astype(np.int64), self.hot[by], self.place[by]

    def times(self, learned: np.ndarray) -> np.ndarray:
        """Training tokens of each n-gram."""
        return np.add.reduceat(learned[self.tokens].astype(np.int64), self.at)[self.by] if len(self.at) else self.at

    def spread(self, values: np.ndarray, out: np.ndarray) -> None:
        """Puts each n-gram's value to all of its tokens."""
        of = np.empty(len(values))
        of[self.by] = values
        out[self.tokens] = np.repeat(of, np.diff(np.append(self.at, len(self.tokens))))


ANSWERS = "part int, bucket int, chunk long, counts binary, over binary, rest binary, small binary, counts_of array<long>, hot array<double>, keys array<long>, key_counts array<long>"


def answers(chunk_rows: DataFrame, order: int, lower: Lower, hot: np.ndarray, most: int, buckets: int, part: int, parts: int) -> DataFrame:
    """:data:`ANSWERS` to each chunk's :class:`Requests`, in their order.

    ``counts``: training tokens of the n-gram; ``over``: what its context's are divided by, 0 if it
    has none.  Only of n-grams without a count, ``rest``: the probability one order lower, divided by
    that of all words not seen there; ``small``: how many n-grams of the context have each count up to
    ``CUTOFF``.  For frequent contexts (``hot``) the divisors stay out.  On the row of a bucket's first
    chunk: its counts-of-counts, sums for each frequent context (total, small counts, lower
    probability of what was seen), and n-grams with over ``most`` tokens.
    """
    sent = "bucket int, chunk long, contexts binary, keys binary, times binary, low binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = Chunk(row)
                r = Requests(c, order, hot, buckets, part, parts)
                times, low = r.times(c.learned), c.low(lower, r.first)
                edges = np.flatnonzero(np.diff(r.bucket, prepend=-1, append=-1)).tolist() if len(r.bucket) else []
                yield _rows(sent, [(int(r.bucket[a]), row["chunk"], r.context[a:b].tobytes(), r.key[a:b].tobytes(), _packed(times[a:b]), low[a:b].tobytes()) for a, b in zip(edges, edges[1:])])
        memory_returned()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        edge = np.concatenate([[0], np.cumsum([len(w) // 8 for w in group["contexts"]])])
        keys = _joined(group["keys"], "<u8")
        order, at = _groups(keys)
        count = np.add.reduceat(_unpacked(group["times"])[order], at)
        gram = np.empty(len(order), dtype=np.int32)
        gram[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(order))))
        one = order[at]
        del order, at
        context, low = _joined(group["contexts"], "<u8")[one], _joined(group["low"], "<f8")[one]
        frequent = np.flatnonzero(count > most)
        keys = keys[one[frequent]]
        by, first = _groups(context)
        of = np.empty(len(by), dtype=np.int32)
        of[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(by))))
        total = np.add.reduceat(count[by], first)
        mass = np.add.reduceat(np.where(count > 0, low, 0.0)[by], first)
        few = (count > 0) & (count <= CUTOFF)
        small = np.bincount(of[few].astype(np.int64) * CUTOFF + count[few] - 1, minlength=len(first) * CUTOFF).astype(np.int32).reshape(-1, CUTOFF)
        is_hot, place = _place(hot, context[by[first]])
        sums = np.zeros((len(hot), CUTOFF + 2))
        sums[place[is_hot]] = np.column_stack([total, small, mass])[is_hot]
        over = np.where(is_hot, 0, divisor(total, small))
        rest = low / np.where(is_hot | (total == 0), 1.0, np.maximum(1 - mass, 1e-12))[of]
        counts_of = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
        del by, few, low, context
        out = []
        for a, b in zip(edge, edge[1:]):
            g = gram[a:b]
            none = g[count[g] == 0]
            out.append((_packed(count[g]), _packed(over[of[g]]), rest[none].tobytes(), _packed(np.where(is_hot[of[none], None], 0, small[of[none]]).reshape(-1))))
        own = [(counts_of.tolist(), sums.reshape(-1).tolist(), keys.view(np.int64).tolist(), count[frequent].tolist())] + [([], [], [], [])] * (len(group) - 1)
        rows = [(part, *x, *y, *z) for x, y, z in zip(zip(group["bucket"], group["chunk"]), out, own)]
        del gram, of, small, rest, over, group
        memory_returned()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return chunk_rows.mapInArrow(send, sent).groupBy("bucket").applyInPandas(add, ANSWERS)


def divisor(total: np.ndarray, small: np.ndarray) -> np.ndarray:
    """What a context's counts are divided by: one more than their sum if no count is discounted."""
    return np.where(total > 0, total + (small.sum(axis=1) == 0), 0)


class Level:
    """The bounded part of one order: discounts, frequent contexts with their sums, and the frequent n-grams."""

    def __init__(self, answered: DataFrame, hot: np.ndarray):
        def added(column: str) -> list:
            return [r[1] for r in sorted(answered.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col")).collect())]

        self.hot = hot
        self.d = np.array(discounts([0, *(added("counts_of") or [0] * (CUTOFF + 1))]))
        sums = np.array(added("hot") if len(hot) else [], dtype=np.float64)
        sums = sums.reshape(-1, CUTOFF + 2) if len(sums) else np.zeros((len(hot), CUTOFF + 2))
        total, small, mass = sums[:, 0], sums[:, 1:-1], sums[:, -1]
        self.over = divisor(total, small)
        self.weight = np.where(total > 0, self.left(self.over, small) / np.maximum(1 - mass, 1e-12), 1.0)
        pairs = answered.select(F.explode("keys")).collect()
        self.frequent = np.array([r[0] for r in pairs], dtype=np.int64).view(np.uint64)

    def left(self, over: np.ndarray, small: np.ndarray) -> np.ndarray:
        """The share that a context's discounts leave; all of it where it has no counts."""
        taken = small @ (np.arange(1, CUTOFF + 1) * (1 - self.d[1:]))
        return np.where(over > 0, np.where(small.sum(axis=1) == 0, 1.0, taken) / np.maximum(over, 1), 1.0)

    def probability(self, r: Requests, told: list[dict]) -> np.ndarray:
        """Of each request, from the answers in its order."""
        count, over = _unpacked([t["counts"] for t in told]), _unpacked([t["over"] for t in told]).astype(np.float64)
        rest, small = _joined([t["rest"] for t in told], "<f8"), _unpacked([t["small"] for t in told]).reshape(-1, CUTOFF)
        none = np.flatnonzero(count == 0)
        left = self.left(over[none], small)
        if len(self.hot):
            over = np.where(r.hot, self.over[r.place], over)
            left = np.where(r.hot[none], self.weight[r.place[none]], left)
        p = np.where(count <= CUTOFF, self.d[np.minimum(count, CUTOFF)], 1.0) * count / np.maximum(over, 1)
        p[none] = left * rest
        return p


def token_probabilities(c: Chunk, told: list[dict], order: int, level: Level, buckets: int, parts: int) -> np.ndarray:
    """Of each token of a chunk in its context, from all answers to the chunk."""
    out = np.empty(len(c.tokens))
    for part in range(parts):
        r = Requests(c, order, level.hot, buckets, part, parts)
        r.spread(level.probability(r, sorted((t for t in told if t["part"] == part), key=lambda t: t["bucket"])), out)
    return out


def _told(chunk_rows: list[DataFrame], answered: DataFrame, part: int, parts: int) -> DataFrame:
    """One part of the chunks, each with ``told``: all answers to it.

    ``chunk_rows``: a table of all chunks, or one for each part.
    """
    mine = F.pmod(F.xxhash64("chunk"), F.lit(parts)) == part
    told = answered.filter(mine).groupBy("chunk").agg(F.collect_list(F.struct("part", "bucket", "counts", "over", "rest", "small")).alias("told"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    own = chunk_rows[part] if len(chunk_rows) == parts else chunk_rows[0]
    return own.filter(mine).select(*names, "counts").join(told, "chunk")


def _by_part(make: Callable[[int], DataFrame], parts: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The parts, written one after the other, together and each."""
    each = [written(make(part), name, CHUNK_ROWS) for part in range(parts)]
    return reduce(DataFrame.unionByName, each), each


def lowered(chunk_rows: list[DataFrame], answered: DataFrame, order: int, level: Level, buckets: int, parts: int, part: int) -> DataFrame:
    """One part of the chunks with ``low binary``: each token's probability of this order, which the next one falls back on."""
    schema = CHUNKS + ", counts binary, low binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                p = token_probabilities(Chunk(row), row["told"], order, level, buckets, parts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(7)), pa.array([p.tobytes()], pa.binary())], [c.split()[0] for c in schema.split(", ")])
        memory_returned()

    return _told(chunk_rows, answered, part, parts).mapInArrow(run, schema)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finished(chunk_rows: list[DataFrame], answered: DataFrame, order: int, lower: Lower, level: Level, buckets: int, parts: int, part: int) -> DataFrame:
    """:data:`SCORES` of the documents of one part of the chunks, from the answers of the highest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = Chunk(row)
                n = len(c.lengths)
                count = c.counts[c.tokens]
                base = np.bincount(c.doc, weights=np.log10((count + 1) / (lower.total + lower.types + 1)), minlength=n)
                known = np.bincount(c.doc, weights=count > 0, minlength=n).astype(np.int64)
                p = token_probabilities(c, row["told"], order, level, buckets, parts)
                score = np.bincount(c.doc, weights=np.log10(p), minlength=n)
                cols = [pa.array(c.ids, mask=c.nulls), pa.array(c.held), pa.array(c.lengths), pa.array(known), pa.array(np.full(n, lower.total)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])
        memory_returned()

    return _told(chunk_rows, answered, part, parts).mapInArrow(run, SCORES)


def katz_scores(docs: DataFrame, folds: int = 7, fold: int = 2, rounds: int = ROUNDS, bucket: int = BUCKET, order: int = 2) -> DataFrame:
    """:data:`SCORES`: every text's tokens, known tokens, baseline and log10 probability.

    The model learns from rows whose ``crc32(doc_id as text) mod folds`` is not
    ``fold``; a null id is not held out.  ``order``: words of the longest n-grams, 2 or
    more.  A null or empty text is the end token alone.
    Repeated rows count and are scored as often as they stand.  Without training rows
    every token is the one unknown word.  An empty table gives no rows; other columns
    are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    encoded = written(chunks(texts_of(docs).select("doc_id", "text", held.alias("held"))), "chunks")
    tokens = encoded.agg(F.sum(F.length("tokens") / 4)).first()[0] or 0
    buckets = max(1, math.ceil(tokens / bucket))
    counted = written(word_counts(encoded, buckets), "counts")
    sums = counted.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect()
    sums = [v for _, v in sorted((r[0], r[1]) for r in sums)] or [0] * (CUTOFF + 3)
    lower = Lower(sums[0], sums[1], [0, *sums[2:]])
    most = int(HOT * lower.total)
    ready = written(annotated(encoded, counted.select("chunk", "words", "counts")), "annotated")
    hot, texts = frequent_contexts(ready, most)
    discard(encoded)
    discard(counted)
    below = [ready]
    for n in range(2, order + 1):
        answered, parts = _by_part(partial(answers, ready, n, lower, hot, most, buckets, parts=rounds), rounds, "answers")
        level = Level(answered, hot)
        if n < order:
            out, higher = _by_part(partial(lowered, below, answered, n, level, buckets, rounds), rounds, "lowered")
            hot = np.sort(np.append(level.frequent, [start_of(n + 1)] if texts > most else np.zeros(0, np.uint64)).astype(np.uint64))
        else:
            out, higher = _by_part(partial(finished, below, answered, n, lower, level, buckets, rounds), rounds, "scores")
        for df in (*below, *parts):
            discard(df)
        ready, below = out, higher
    return ready


def frequent_contexts(chunk_rows: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Hashes of the words with over ``most`` tokens, and of the start if it has; sorted, at most ``1 / HOT``; and the training texts.

    Every token but the end is the context of one other, and the start of one for each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = Chunk(batch.slice(k, 1).to_pylist()[0])
                on = np.flatnonzero((c.counts > most) & (c.vocabulary != END))
                rows = [(int(w), 0) for w in c.vocabulary[on].view(np.int64)]
                yield _rows("word long, texts long", [*rows, (int(START), int((~c.held).sum()))])

    found = chunk_rows.mapInArrow(run, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).collect()
    texts = sum(r["texts"] for r in found)
    chosen = {r["word"] for r in found if r["word"] != int(START)} | ({int(START)} if texts > most else set())
    return np.sort(np.array(list(chosen), dtype=np.int64).view(np.uint64)), texts


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents, learning from six of seven folds."""
    return katz_scores(table(spark, sf_dir, "documents"), order=ORDER)
