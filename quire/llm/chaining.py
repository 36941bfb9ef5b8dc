"""Operator 2: substring dedup by collinear chaining of shared k-mer seeds.

Seeds are word k-mers, one minimum of each window of consecutive k-mers, so any
two texts with a run of ``K + WINDOW - 1`` equal words share one.  Every
occurrence of a shared seed is joined with the seed's first document only (the
smallest id), never with all others: a passage in very many documents costs one
anchor for each occurrence.

Where the seeds of a stretch have different first documents, none of these need hold
the stretch as a whole.  So spans of successive shared seeds (with their distances)
are keys too, of each length in ``SPANS``, and are joined with the span's own first
document.  A span of ``PASSAGE_WORDS`` words makes a passage with whatever document it is
joined with, so a long equal passage is covered however many earlier documents hold
pieces of it.

The anchors of a document with one source are joined to runs on a diagonal and
chained: in order of their start, each run takes the best chain that ends before
it in both texts, less a cost for the gaps, from a Fenwick tree of maxima over
the source's positions.  Chains are then aligned word by word (runs, gaps
between them, and an extension at both ends), which gives the fuzzy passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import discard, memory_returned, scope, table, texts_of, written
from quire.llm.words import _powers, mix, shingles_in_order, slices, text_bytes, words

K, WINDOW = 5, 6
#: A chain has so many matching words before it is aligned; a passage so many words and such a share of equal ones.
CHAIN_WORDS, PASSAGE_WORDS, IDENTITY = 8, 40, 0.8
#: Cost of each word of a gap; an extension ends when its score falls so far below its best.
GAP_COST, DROP = 0.3, 8
#: Words beyond a chain that are fetched at first; chains that go on beyond them are aligned in whole texts.
REACH = 200
#: Rows with both stretches that a task aligns at once, and rows with both whole texts.
ALIGNED_ROWS, WHOLE_ROWS = 256, 32
#: Bytes of texts that a task cuts passages from at once, one text at least.
CUT_BYTES = 1 << 20
#: Words of the spans of seeds, at least; at most twice as many.
SPANS = (10, 20, PASSAGE_WORDS)
#: Words next to the diagonal that the first, narrowest alignment of a gap looks at.
_BAND = 64

PASSAGES = "doc_id long, start int, length int, source_id long, source_start int, source_length int, matches int, text_hash long"


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``seed long, doc_id long, pos int``: the chosen k-mers of each text, with the word they start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_returned()
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(1)):
                value, row, pos = shingles_in_order(*words(*text_bytes(batch.column(1).slice(a, b - a))), b - a, k)
                at = minima(value, row, window)
                yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), pa.array(doc[a:b][row[at]]), pa.array(pos[at].astype(np.int32))], ["seed", "doc_id", "pos"])
        memory_returned()

    return docs.mapInArrow(run, "seed long, doc_id long, pos int")


def minima(value: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Where the leftmost minimum of some window of a row stands; rows shorter than a window count as one."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    count = np.diff(starts, append=n)
    first, last = np.repeat(starts, count), np.repeat(starts + count, count)
    best = np.arange(n)
    size = 1
    while size < window:
        step = min(size, window - size)
        other = np.minimum(np.arange(n) + step, n - 1)
        other = np.where(other < last, other, np.arange(n))
        right = best[other]
        best = np.where(value[right] < value[best], right, best)
        size += step
    whole = (np.arange(n) + window <= last) | (np.arange(n) == first)
    # the minima of later windows never stand further left
    best = best[whole]
    return best[np.flatnonzero(np.diff(best, prepend=-1))]


def shared_anchors(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, source_id, pos, source_pos, n``: each occurrence of a seed with its first document, and of a span with its own.

    ``n``: words of the seed or span.
    """
    of_doc = written(of_documents(with_first(seeds(docs, k, window))), "of-doc")
    asking = written(spans(of_doc, True, k), "asking")
    held = spans(of_doc, False, k).groupBy("key").agg(F.min("doc_id").alias("source_id"), F.min_by("pos", "doc_id").alias("source_pos"), F.max("doc_id").alias("last"))
    held = held.filter(F.col("source_id") != F.col("last")).drop("last")
    wide = asking.join(held, "key").filter(F.col("source_id") < F.col("doc_id")).select("doc_id", "source_id", "pos", "source_pos", "n")
    wide = written(wide, "wide-anchors")
    discard(asking)
    single = of_doc.select("doc_id", F.inline(F.arrays_zip("source_id", "pos", "source_pos"))).filter(F.col("doc_id") != F.col("source_id")).withColumn("n", F.lit(k))
    anchors = written(single.unionByName(wide), "anchors")
    discard(of_doc)
    discard(wide)
    return anchors


def with_first(found: DataFrame) -> DataFrame:
    """The rows of seeds that several documents have, with the seed's first document and its first place there."""
    names = ["doc_id", "pos", "seed", "source_id", "source_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_returned()
        # of the seed that a batch ended in: its rows while they are of one document, then its first place
        held: list[np.ndarray] | None = None
        known: tuple[int, int, int] | None = None
        for batch in batches:
            seed, doc, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if held:
                seed, doc, pos = (np.concatenate(c) for c in zip(held, (seed, doc, pos)))
            if not len(seed):
                continue
            begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            count = np.diff(begin, append=len(seed))
            source, at = doc[begin], pos[begin]
            shared = doc[begin + count - 1] != source
            if known and known[0] == seed[0]:
                source[0], at[0], shared[0] = known[1], known[2], True
            if shared[-1]:
                held, known = None, (int(seed[-1]), int(source[-1]), int(at[-1]))
            else:
                held, known = [c[begin[-1] :] for c in (seed, doc, pos)], None
            keep = np.repeat(shared, count)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, pos, seed, np.repeat(source, count), np.repeat(at, count))], names)
        memory_returned()

    dealt = found.repartition("seed").sortWithinPartitions("seed", "doc_id", "pos")
    return dealt.mapInArrow(run, "doc_id long, pos int, seed long, source_id long, source_pos int")


def of_documents(rows: DataFrame) -> DataFrame:
    """``doc_id, pos, seed, source_id, source_pos``: one row for each document, as its text is, with lists by place; equal rows count once."""
    names = ["doc_id", "pos", "seed", "source_id", "source_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if not len(cols[0]):
                continue
            # rows before the batch's last document are of whole documents, with those held
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if held and (last or cols[0][0] != held[-1][0][-1]):
                held.append([c[:last] for c in cols])
                yield lists(*(np.concatenate(c) for c in zip(*held)))
                held = []
            elif last:
                yield lists(*(c[:last] for c in cols))
            held.append([c[last:] for c in cols])
        if held:
            yield lists(*(np.concatenate(c) for c in zip(*held)))
        memory_returned()

    def lists(doc: np.ndarray, pos: np.ndarray, seed: np.ndarray, source: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (seed[1:] != seed[:-1])
        doc = doc[new]
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        ends = pa.array(np.append(begin, len(doc)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(doc[begin]), *(pa.ListArray.from_arrays(ends, pa.array(c[new])) for c in (pos, seed, source, at))], names)

    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "seed")
    return dealt.mapInArrow(run, "doc_id long, pos array<int>, seed array<long>, source_id array<long>, source_pos array<int>")


def spans(of_doc: DataFrame, asking: bool, k: int = K) -> DataFrame:
    """``key long, doc_id long, pos int, n int``: from each seed the shortest span of each of the lengths in ``SPANS``.

    ``asking``: only spans that may have an earlier holder and that their seeds do not
    join with one document on one diagonal already; else the first place of every key
    of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in range(1, 5)]
            count = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            pos, seed, source, at = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
            if not len(pos):
                continue
            row = np.repeat(np.arange(len(count)), count)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
            end = np.cumsum(count)[row]
            up, down = _powers.get(int(pos.max()) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(seed.view(np.uint64)) * up[pos])])
            place = (row << 32) + pos
            late = np.concatenate([[0], np.cumsum(source >= doc)])
            moved = np.zeros(len(pos), dtype=np.int64)
            moved[1:] = (source[1:] != source[:-1]) | ((pos - at)[1:] != (pos - at)[:-1])
            moved = np.cumsum(moved)
            for words_of in SPANS:
                last = np.searchsorted(place, place + words_of - k)
                on = np.flatnonzero(last < end)
                to = last[on]
                n = pos[to] + k - pos[on]
                keep = n <= 2 * words_of
                if asking:
                    keep &= (late[to + 1] == late[on]) & (moved[to] != moved[on])
                on, to, n = on[keep], to[keep], n[keep]
                key = mix((sums[to + 1] - sums[on]) * down[pos[on]] + np.uint64(words_of))
                if not asking:
                    # rows and places ascend, and the sort is stable
                    order = np.lexsort((key, row[on]))
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (key[order][1:] != key[order][:-1]) | (row[on][order][1:] != row[on][order][:-1])
                    some = order[new]
                    on, n, key = on[some], n[some], key[some]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[on], pa.int64()), pa.array(pos[on].astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "doc_id", "pos", "n"])
        memory_returned()

    return of_doc.mapInArrow(run, "key long, doc_id long, pos int, n int")


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, item)
            at += at & -at

    def most(self, end: int) -> tuple[float, int]:
        """Over positions below ``end``."""
        out = (-1e18, -1)
        while end > 0:
            if self.best[end][0] > out[0]:
                out = self.best[end]
            end -= end & -end
        return out


def runs(group: np.ndarray, pos: np.ndarray, source: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each run, and rows ``(start, source start, length)``: anchors of ``n`` words of a group's diagonal that follow each other closely."""
    diagonal = pos - source
    order = np.lexsort((pos, diagonal, group))
    p, d, g = pos[order], diagonal[order], group[order]
    other = np.ones(len(p), dtype=bool)
    other[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    apart = np.cumsum(other) << 40
    end = np.maximum.accumulate(p + n[order] + apart) - apart
    new = other.copy()
    new[1:] |= p[1:] - end[:-1] > window
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    out = np.stack([p[at], p[at] - d[at], end[last] - p[at]], axis=1)
    order = np.lexsort((out[:, 1], out[:, 0], g[at]))
    return g[at][order], out[order]


def chains(blocks: np.ndarray, least: int, cost: float = GAP_COST) -> list[list[int]]:
    """The best chains of runs, each run in one; of those with ``least`` matching words.

    A chain's score is its matching words less ``cost`` for each word between runs in
    either text, so that far runs start a chain of their own.
    """
    x, y, n = blocks[:, 0].tolist(), blocks[:, 1].tolist(), blocks[:, 2].tolist()
    if len(x) == 1:
        return [[0]] if n[0] >= least else []
    ends = np.unique(blocks[:, 1] + blocks[:, 2])
    tree = Fenwick(len(ends))
    start_rank = np.searchsorted(ends, blocks[:, 1], side="right").tolist()
    end_rank = np.searchsorted(ends, blocks[:, 1] + blocks[:, 2]).tolist()
    score, before = [float(v) for v in n], [-1] * len(x)
    waiting = sorted(range(len(x)), key=lambda i: x[i] + n[i])
    done = 0
    for j in range(len(x)):
        while done < len(waiting) and x[waiting[done]] + n[waiting[done]] <= x[j]:
            i = waiting[done]
            tree.put(end_rank[i], score[i] + cost * (x[i] + y[i] + 2 * n[i]), i)
            done += 1
        value, i = tree.most(start_rank[j])
        gain = value - cost * (x[j] + y[j])
        if i >= 0 and gain > 0:
            score[j] += gain
            before[j] = i
    used, out = [False] * len(x), []
    for j in sorted(range(len(x)), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if sum(n[i] for i in chain) >= least:
            out.append(chain[::-1])
    return out


def chained(anchors: DataFrame, window: int = WINDOW, least: int = CHAIN_WORDS) -> DataFrame:
    """``doc_id, source_id, xs, ys, ns``: the runs of each chain.

    Groups are the anchors of one document with one source: a few times as many as the
    document has words at most, however many documents share a passage.
    """
    schema = "doc_id long, source_id long, xs array<int>, ys array<int>, ns array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc: np.ndarray, source: np.ndarray, pos: np.ndarray, at: np.ndarray, n: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            """The chains of whole groups, which begin at ``first``."""
            group, blocks = runs(np.repeat(np.arange(len(first)), np.diff(first, append=len(doc))), pos, at, n, window)
            count = np.bincount(group, minlength=len(first))
            # a single run is its group's chain
            some = np.flatnonzero((count[group] == 1) & (blocks[:, 2] >= least))
            groups, sizes, parts = [group[some]], [np.ones(len(some), np.int64)], [blocks[some]]
            begin = np.cumsum(count) - count
            for g in np.flatnonzero(count > 1).tolist():
                of = blocks[begin[g] : begin[g] + count[g]]
                for c in chains(of, least):
                    groups.append(np.array([g]))
                    sizes.append(np.array([len(c)]))
                    parts.append(of[c])
            groups, runs_of = first[np.concatenate(groups)], np.concatenate(parts)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(runs_of[:, c], pa.int32())) for c in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(doc[groups]), pa.array(source[groups]), *lists], ["doc_id", "source_id", "xs", "ys", "ns"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)]
            if held:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            first = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))
            if len(first) > 1:
                yield rows(*(c[: first[-1]] for c in cols), first[:-1])
            held = [c[first[-1] :] for c in cols]
        if held:
            yield rows(*held, np.zeros(1, np.int64))
        memory_returned()

    dealt = anchors.repartition("doc_id", "source_id").sortWithinPartitions("doc_id", "source_id", "pos", "source_pos")
    return dealt.mapInArrow(run, schema)


def word_arrays(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, words array<long>``; of several texts of one id the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashes, row = words(*text_bytes(batch.column(1).slice(a, b - a)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists], ["doc_id", "text_hash", "words"])
        memory_returned()

    one = docs.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return one.mapInArrow(run, "doc_id long, text_hash long, words array<long>")


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words that the best alignment of two stretches has in common.

    Beginnings and ends that are equal are set aside; the rest is aligned in a band about
    the diagonal, which is widened until twice as wide a band finds no more.
    """
    m = min(len(a), len(b))
    if not m:
        return 0
    unlike = np.flatnonzero(a[:m] != b[:m])
    head = int(unlike[0]) if len(unlike) else m
    a, b = a[head:], b[head:]
    m -= head
    unlike = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(unlike[0]) if len(unlike) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    band, found = _BAND, -1
    while True:
        more = _in_band(a, b, band)
        if more == found or band >= max(len(a), len(b)):
            return head + tail + more
        band, found = 2 * band, more


def _in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of places that are at most ``band`` (beside the difference in length) off the diagonal."""
    skew = len(b) - len(a)
    low, high = min(0, skew) - band, max(0, skew) + band  # of b's place less a's
    row = np.zeros(high - low + 2, dtype=np.int32)  # by diagonal; the last cell is none
    padded = np.zeros(len(b) + len(a) + 2 * (high - low) + 4, dtype=b.dtype)
    valid = np.zeros(len(padded), dtype=bool)
    shift = -low
    padded[shift : shift + len(b)] = b
    valid[shift : shift + len(b)] = True
    width = high - low + 1
    for i, x in enumerate(a):
        at = slice(i, i + width)
        met = (padded[at] == x) & valid[at]
        row[:-1] = np.maximum.accumulate(np.maximum(row[:-1] + met, row[1:]))
    return int(row[:-1].max())


def extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bool]:
    """How far two stretches go on alike, how many words agree there, and whether a stretch ended before the score fell.

    They are read in blocks.
    """
    m = min(len(a), len(b))
    start, score, best, end, equal, agreed, ran = 0, 0, 0, 0, 0, 0, True
    while start < m:
        size = min(m - start, 256)
        same = a[start : start + size] == b[start : start + size]
        run = score + np.cumsum(np.where(same, 1, -2))
        low = np.flatnonzero(run < np.maximum(np.maximum.accumulate(run), best) - DROP)
        stop = int(low[0]) if len(low) else size
        if stop and run[:stop].max() > best:
            at = int(np.argmax(run[:stop]))
            best, end, agreed = int(run[at]), start + at + 1, equal + int(same[: at + 1].sum())
        if len(low):
            ran = False
            break
        score, equal, start = int(run[-1]), equal + int(same.sum()), start + size
    return end, agreed, ran


def goes_on(ran: bool, left_a: int, left_b: int, open_a: bool, open_b: bool) -> bool:
    """Whether an extension that ran to the end of ``left_a`` or ``left_b`` words may go on in words that were not fetched.

    ``open_a``, ``open_b``: there are such words.  It needs words of both texts, so a text that really ends there ends it.
    """
    return ran and (left_a > left_b or open_a) and (left_b > left_a or open_b)


def aligned(xs: list[int], ys: list[int], ns: list[int], a: np.ndarray, b: np.ndarray, beyond: tuple[bool, bool, bool, bool]) -> tuple[int, int, int, int, int, bool]:
    """Start and length in both texts and equal words of a chain, and whether it may go on ``beyond`` the words of ``a`` or ``b``."""
    equal = 0
    for k, (x, y, n) in enumerate(zip(xs, ys, ns)):
        equal += int((a[x : x + n] == b[y : y + n]).sum())
        if k:
            equal += common_words(a[xs[k - 1] + ns[k - 1] : x], b[ys[k - 1] + ns[k - 1] : y])
    x0, y0, x1, y1 = xs[0], ys[0], xs[-1] + ns[-1], ys[-1] + ns[-1]
    back, more, to_start = extension(a[:x0][::-1], b[:y0][::-1])
    ahead, still, to_end = extension(a[x1:], b[y1:])
    on = goes_on(to_start, x0, y0, *beyond[:2]) or goes_on(to_end, len(a) - x1, len(b) - y1, *beyond[2:])
    return x0 - back, x1 - x0 + back + ahead, y0 - back, y1 - y0 + back + ahead, equal + more + still, on


def accepted(xs: list[int], ys: list[int], ns: list[int], a: np.ndarray, b: np.ndarray, least: int, identity: float, beyond: tuple[bool, bool, bool, bool] = (False,) * 4) -> tuple[list[tuple[int, int, int, int, int]], bool]:
    """The alignment of a chain if it is long and alike enough in ``a``; else those of its two sides of the widest gap.

    ``beyond``: whether the texts have words before ``a`` and ``b``, and after them, that are not here; also returned
    is whether an alignment may go on there.
    """
    waiting, out, more = [(0, len(xs))], [], False
    while waiting:
        i, j = waiting.pop()
        *found, on = aligned(xs[i:j], ys[i:j], ns[i:j], a, b, beyond)
        more = more or on
        if found[1] >= least and found[4] >= identity * found[1]:
            out.append(tuple(found))
        elif j - i > 1 and found[1] >= least:
            gaps = [xs[k] - xs[k - 1] - ns[k - 1] + ys[k] - ys[k - 1] - ns[k - 1] for k in range(i + 1, j)]
            cut = i + 1 + int(np.argmax(gaps))
            waiting += [(cut, j), (i, cut)]
    return out, more


def extensions(a: np.ndarray, at: np.ndarray, b: np.ndarray, b_at: np.ndarray, m: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`extension` for many stretches at once: of ``a`` from the places ``at`` and of ``b`` from ``b_at``, ``m`` words each.

    ``way``: 1 ahead, -1 back.
    """
    end, agreed, ran = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), np.ones(len(m), bool)
    score, best, equal = (np.zeros(len(m), np.int64) for _ in range(3))
    some, start, size = np.flatnonzero(m > 0), 0, 16
    while len(some):
        place = start + np.arange(size)
        there = place < m[some, None]
        step = np.where(there, place, 0) * way
        same = (a[at[some, None] + step] == b[b_at[some, None] + step]) & there
        # places beyond a stretch change no score
        run = score[some, None] + np.cumsum(np.where(same, 1, np.where(there, -2, 0)), axis=1)
        low = run < np.maximum(np.maximum.accumulate(run, axis=1), best[some, None]) - DROP
        stopped = low.any(axis=1)
        stop = np.where(stopped, low.argmax(axis=1), size)
        equals = equal[some, None] + np.cumsum(same, axis=1)
        lines = np.arange(len(some))
        until = np.where(np.arange(size) < stop[:, None], run, np.iinfo(np.int64).min)
        top = until.argmax(axis=1)
        better = until[lines, top] > best[some]
        on = some[better]
        best[on], end[on], agreed[on] = until[lines, top][better], start + top[better] + 1, equals[lines, top][better]
        ran[some[stopped]] = False
        score[some], equal[some] = run[:, -1], equals[:, -1]
        start += size
        some = some[~stopped & (m[some] > start)]
        size = min(2 * size, 256)
    return end, agreed, ran


def passages(docs: DataFrame, least: int = PASSAGE_WORDS, identity: float = IDENTITY) -> DataFrame:
    """The passages of documents that stand, perhaps changed a little, in one of smaller id.

    ``doc_id, start, length, source_id, source_start, source_length, matches,
    text_hash``: places in words; of the document's ``least`` words or more at least
    ``identity`` stand in the source in this order (``matches``).  A document that repeats passages of
    several others has a row for each.  Null, empty and short texts have no seeds and
    no rows; rows with a null ``doc_id`` take no part; equal rows count once, and of
    several texts with one id the largest is aligned; an empty table gives no rows;
    other columns are ignored.
    """
    docs = texts_of(docs).filter(F.col("doc_id").isNotNull())
    anchors = shared_anchors(docs)
    found = written(chained(anchors), "chains")
    discard(anchors)
    named = found.select("doc_id").union(found.select("source_id")).distinct()
    of = written(word_arrays(docs.join(named, "doc_id", "left_semi")), "words")
    near = written(_aligned(found, of, REACH, least, identity), "near", ALIGNED_ROWS)
    # chains that go on beyond what was fetched
    far = near.filter("more").select("doc_id", "source_id", "xs", "ys", "ns")
    whole = written(_aligned(far, of, None, least, identity), "whole", WHOLE_ROWS)
    return near.filter("NOT more").unionByName(whole).select("doc_id", "source_id", "start", "length", "source_start", "source_length", "matches", "text_hash").distinct()


def _aligned(found: DataFrame, of: DataFrame, reach: int | None, least: int, identity: float) -> DataFrame:
    """:data:`PASSAGES` with no more than ``reach`` words of the texts beyond a chain; where it goes on there, ``more`` and the chain instead."""
    low, high = F.element_at("xs", 1), F.element_at("xs", -1) + F.element_at("ns", -1)
    s_low, s_high = F.element_at("ys", 1), F.element_at("ys", -1) + F.element_at("ns", -1)
    none, size = F.lit(0), F.lit(2**31 - 1)
    edges = [none, size, none, size] if reach is None else [F.greatest(none, low - reach), high + reach, F.greatest(none, s_low - reach), s_high + reach]
    cut = found.select("*", *(e.alias(n) for e, n in zip(edges, ("from", "to", "s_from", "s_to"))))
    part = cut.join(of, "doc_id").withColumn("a", F.slice("words", F.col("from") + 1, F.col("to") - F.col("from"))).withColumn("cut_a", F.col("to") < F.size("words")).drop("words")
    source = of.select(F.col("doc_id").alias("source_id"), F.col("words").alias("s_words"))
    both = part.join(source, "source_id").withColumn("b", F.slice("s_words", F.col("s_from") + 1, F.col("s_to") - F.col("s_from")))
    both = both.select("doc_id", "source_id", "xs", "ys", "ns", "from", "s_from", "a", "b", "text_hash", "cut_a", (F.col("s_to") < F.size("s_words")).alias("cut_b"))
    chain = PASSAGES + ", more boolean, xs array<int>, ys array<int>, ns array<int>"
    names = [c.split()[0] for c in chain.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_returned()
        for batch in batches:
            count = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            single = np.flatnonzero(count == 1)
            if len(single):
                yield from single_runs(batch if len(single) == len(count) else batch.take(pa.array(single)))
            if len(single) < len(count):
                yield from chains_of(batch.take(pa.array(np.flatnonzero(count > 1))))
        memory_returned()

    def going_on(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of chains that go on."""
        none = [pa.nulls(batch.num_rows, kinds[k]) for k in (1, 2, 4, 5, 6, 7)]
        cols = [batch.column(0), *none[:2], batch.column(1), *none[2:], pa.repeat(True, batch.num_rows), *(batch.column(c) for c in (2, 3, 4))]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, kinds)], names)

    def found_here(cols: list[pa.Array]) -> pa.RecordBatch:
        """Rows of passages."""
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([*cols, pa.repeat(False, n), *(pa.nulls(n, t) for t in kinds[9:])], names)

    def single_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chains of one run, all at once."""
        doc, source, start, s_start, text, cut_a, cut_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 5, 6, 9, 10, 11))
        x, y, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4))
        x, y = x - start, y - s_start
        (a, a_at, a_n), (b, b_at, b_n) = (stretches(batch.column(c)) for c in (7, 8))
        fits = (x + n <= a_n) & (y + n <= b_n)  # else of another text with this id
        if not fits.all():
            batch = batch.filter(pa.array(fits))
            doc, source, start, s_start, text, cut_a, cut_b, x, y, n, a_at, a_n, b_at, b_n = (v[fits] for v in (doc, source, start, s_start, text, cut_a, cut_b, x, y, n, a_at, a_n, b_at, b_n))
        offset = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(offset, n)
        same = np.concatenate([[0], np.cumsum(a[np.repeat(a_at + x, n) + within] == b[np.repeat(b_at + y, n) + within])])
        equal = same[offset + n] - same[offset]
        back, more, to_start = extensions(a, a_at + x - 1, b, b_at + y - 1, np.minimum(x, y), -1)
        left_a, left_b = a_n - x - n, b_n - y - n
        ahead, still, to_end = extensions(a, a_at + x + n, b, b_at + y + n, np.minimum(left_a, left_b), 1)
        length, equal = n + back + ahead, equal + more + still
        on = to_start & ((x > y) | (start > 0)) & ((y > x) | (s_start > 0))
        on |= to_end & ((left_a > left_b) | cut_a) & ((left_b > left_a) | cut_b)
        keep = (length >= least) & (equal >= identity * length) & ~on
        cols = (doc, start + x - back, length, source, s_start + y - back, length, equal, text)
        if on.any():
            yield going_on(batch.filter(pa.array(on)))
        if keep.any():
            yield found_here([pa.array(c[keep], t) for c, t in zip(cols, kinds)])

    def chains_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, on = [], []
        a_of, b_of = batch.column(7), batch.column(8)
        for k, r in enumerate(batch.select([0, 1, 2, 3, 4, 5, 6, 9, 10, 11]).to_pylist()):
            a, b = a_of[k].values.to_numpy(zero_copy_only=False), b_of[k].values.to_numpy(zero_copy_only=False)
            xs, ys = [x - r["from"] for x in r["xs"]], [y - r["s_from"] for y in r["ys"]]
            if xs[-1] + r["ns"][-1] > len(a) or ys[-1] + r["ns"][-1] > len(b):
                continue  # of another text with this id
            some, more = accepted(xs, ys, r["ns"], a, b, least, identity, (r["from"] > 0, r["s_from"] > 0, r["cut_a"], r["cut_b"]))
            if more:
                on.append(k)
            else:
                out += [(r["doc_id"], r["from"] + x, n, r["source_id"], r["s_from"] + y, m, equal, r["text_hash"]) for x, n, y, m, equal in some]
        if on:
            yield going_on(batch.take(pa.array(on)))
        if out:
            yield found_here([pa.array(c, t) for c, t in zip(zip(*out), kinds)])

    def stretches(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of all rows, and where each row's begin and how many they are."""
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size, size

    return both.mapInArrow(run, chain)


_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans ``(start, length)`` and the white space before each of them."""
    cover: list[tuple[int, int]] = []
    for start, length in sorted(spans):
        if cover and start <= cover[-1][1]:
            cover[-1] = (cover[-1][0], max(cover[-1][1], start + length))
        else:
            cover.append((start, start + length))
    ends = [m.span() for m in _RUN.finditer(text)]
    out, at = [], 0
    for start, end in cover:
        begin = ends[start - 1][1] if start else 0
        out.append(text[at:begin])
        at = ends[min(end, len(ends)) - 1][1]
    return "".join([*out, text[at:]])


def cut_rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``row, spans`` without their spans, about ``CUT_BYTES`` of text at once."""
    whole = batch.column(0).field("text")
    for a, b in slices(whole.fill_null(""), CUT_BYTES):
        rows = batch.column(0).slice(a, b - a)
        texts, cut = whole.slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
        new = [without(t, [(s["start"], s["length"]) for s in c]) if c else t for t, c in zip(texts, cut)]
        cols = [rows.field(n) for n in names]
        cols[names.index("text")] = pa.array(new, pa.string())
        if "n_chars" in names:
            at = names.index("n_chars")
            old = cols[at].to_pylist()
            cols[at] = pa.array([len(t) if c else v for t, c, v in zip(new, cut, old)], cols[at].type)
        keep = pa.array([not c or bool(t.strip()) for t, c in zip(new, cut)])
        yield pa.RecordBatch.from_arrays(cols, names).filter(keep)


def remove_passages(docs: DataFrame, least: int = PASSAGE_WORDS, identity: float = IDENTITY) -> DataFrame:
    """``docs`` with repeated passages cut out of all but their first document.

    Columns stay as they are; where a text changes, ``n_chars`` (if there is one) is
    its new length.  A text of which nothing is left goes.
    """
    spans = passages(docs, least, identity).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    names = docs.columns
    with scope() as keep:
        spans = keep(written(spans, "spans"))
    packed = docs.select(F.struct(*(docs[n] for n in names)).alias("row"))
    met = (F.col("row.doc_id").cast("long") == spans["doc_id"]) & (F.xxhash64(F.col("row.text")) == spans["text_hash"])
    joined = packed.join(spans, met, "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut_rows(batch, names)
        memory_returned()

    cut = written(joined.mapInArrow(run, docs.schema), "cut")
    # columns that are never null are declared so again, which tables of files are not
    return cut if cut.schema == docs.schema else cut.mapInArrow(lambda batches: batches, docs.schema)


def op2_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the repeated passages of all documents."""
    return passages(table(spark, sf_dir, "documents")).drop("text_hash")
