"""Operator 9: n-gram Jaccard join with PartEnum signatures.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches a threshold.  Sets of sizes ``a <= b`` that link differ in at most
``k = (1 - t) / (1 + t) * (a + b)`` elements.

Signatures.  Sizes fall into bands of equal size (each twice as wide as the one
before); a pair is found in the band of its larger set, so a set also takes part
in the next band if its partners may lie there.  For each band the shingle domain
is divided into first-level partitions and each of these into three parts.
Differences of at most ``k`` leave, among any ``k // 2 + 1`` partitions, one with at
most one difference, hence two of its three parts equal: every two of the three
parts give a signature.  A partition is good for a set that has something in two
parts of it.  A set with too few good partitions also has its ``k + 1`` smallest
shingles as signatures.

Frequent signatures.  A signature is cold if at most ``SHARED`` rows have it: the pairs
of its documents are candidates.  A set gives the signatures of its partitions, in a
fixed order, until a few more than ``k // 2 + 1`` good ones are passed.  If so many of
these have cold signatures only, the set is settled: of two settled sets, the one that
ends first meets the other in a cold signature.  Sets that are not settled are compared
with all that share a frequent signature.  Most of them are members of large groups
of near copies: the member that shares most with its group is
compared with all others first, and only documents that this leaves in other
components are compared with the rest.

Candidates.  A sketch of each set has one bit for each of ``SKETCH`` cells, which says
whether the cell holds an odd number of shingles; two sets differ in as many
shingles as their sketches in bits, at least.  A sketch of fixed size says nothing of
sets that differ in more than half its cells and may still link, so larger sets have a
wide one, too, of two to four cells for each shingle; the wider of two is folded to the
other's size.  Candidates whose sizes or sketches rule a link out go before any set is fetched.  Of the others, only those that still lie in
different components are compared, by exact intersection of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import discard, memory_returned, scope, table, texts_of, written
from quire.llm.components import components
from quire.llm.words import mix, shingles, slices, text_bytes, words

WORDS = 5
#: Similarity in percent.
PERCENT = 75
#: Rows of a cold signature at most.
SHARED = 8
#: Signatures are shuffled in so many parts, one after the other, to bound the disk space of a shuffle.
PARTS = 2
#: Bits of a sketch.
SKETCH = 512
#: Pairs with both wide sketches that a task compares at once.
PAIR_ROWS = 2048
#: Places of the bit map that leaves most signatures which are not frequent out of the second shuffle.
_SLOTS = 1 << 20

_PAIRS = ((0, 1), (0, 2), (1, 2))
_WORDS_OF = [f"s{i}" for i in range(SKETCH // 64)]


def _sets(column: pa.Array, start: int, stop: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their rows of part of a text column."""
    raw, offsets = text_bytes(column.slice(start, stop - start))
    hashes, rows = words(raw, offsets)
    return shingles(hashes, rows, stop - start, size)


def sketches(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, key1, key2, s0.., wide``; the keys stand for the whole set (128 bits), the others are its sketch and its wide one."""
    names = ["doc_id", "n_shingles", "key1", "key2", *_WORDS_OF]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                value, of = _sets(batch.column(1), a, b, size)
                n = np.bincount(of, minlength=b - a)
                keys = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.zeros(b - a, dtype=np.uint64)
                    np.add.at(total, of, mix(value ^ np.uint64(salt)))
                    keys.append(total.view(np.int64))
                spread = mix(value ^ np.uint64(0x2545F4914F6CDD1D))
                bits = odd_cells(spread, of, np.full(b - a, SKETCH)).view("<i8").reshape(b - a, -1)
                cells = np.where(2 * n > SKETCH, 1 << np.frexp(np.maximum(2 * n - 1, 1))[1].astype(np.int64), 0)
                large = cells[of] > 0
                wide = odd_cells(spread[large], of[large], cells)
                ends = np.concatenate([[0], np.cumsum(cells // 8)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *map(pa.array, keys), *(pa.array(c) for c in bits.T.copy()), binary], [*names, "wide"])
        memory_returned()

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", wide binary")


def odd_cells(spread: np.ndarray, of: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of the ``cells`` (powers of two) of each set hold an odd number of elements, as bits, all sets end to end."""
    base = np.cumsum(cells) - cells
    cell = base[of] + (spread & (cells[of] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=int(cells.sum())) & 1).astype(np.uint8), bitorder="little")


def band_limits(sizes: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """The most differences that a set and a partner of the band can have."""
    top = np.minimum((2 << band) - 1, sizes * 100 // percent)
    return (100 - percent) * (sizes + top) // (100 + percent)


def partition_signatures(value: np.ndarray, of: np.ndarray, band: np.ndarray, need: np.ndarray, salt: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their sets, their partitions, whether these are good, and the number of good ones passed by each set.

    ``value, of``: elements and their sets; ``band, need``: of each set.
    """
    upper = (2 << band) - 1
    parts = np.maximum(upper // 6, (100 - percent) * upper // (100 + percent) + 1) + 1
    base = np.concatenate([[0], np.cumsum(parts)])
    spread = mix(value ^ np.uint64(salt))
    first = ((spread >> np.uint64(32)) * parts[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    cell = (base[of] + first) * 3 + ((spread & np.uint64(0xFFFF)) * np.uint64(3) >> np.uint64(16)).astype(np.int64)
    total = np.zeros(3 * base[-1], dtype=np.uint64)
    np.add.at(total, cell, mix(spread))
    full = (np.bincount(cell, minlength=3 * base[-1]) > 0).reshape(-1, 3)
    total = total.reshape(-1, 3)
    owner = np.repeat(np.arange(len(parts)), parts)
    good = full.sum(axis=1) >= 2
    seen = np.concatenate([[0], np.cumsum(good)])
    most = need + need // 8 + 2
    emit = seen[:-1] - seen[base[:-1]][owner] < most[owner]
    passed = np.minimum(seen[base[1:]] - seen[base[:-1]], most)
    place = np.arange(base[-1]) - base[owner]
    out, where = [], []
    for p, (x, y) in enumerate(_PAIRS):
        has = np.flatnonzero(emit & (full[:, x] | full[:, y]))
        label = (place[has] * 3 + p) * 64 + band[owner[has]]
        out.append(mix(total[has, x] * np.uint64(0xD1342543DE82EF95) + mix(total[has, y] + label.astype(np.uint64)) + np.uint64(salt)))
        where.append(has)
    where = np.concatenate(where)
    return np.concatenate(out), owner[where], place[where], good[where], passed


def single_signatures(value: np.ndarray, of: np.ndarray, band: np.ndarray, need: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``need`` smallest elements of each set as signatures, and their sets."""
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(band)))])
    emit = np.arange(len(of)) - first[of] < need[of]
    return mix(mix(value[emit] ^ np.uint64(salt)) + band[of[emit]].astype(np.uint64)), of[emit]


def signatures(value: np.ndarray, of: np.ndarray, n_sets: int, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Signatures, their sets, bands, partitions (-1: none that is good) and spare good partitions of the set.

    ``value``: sorted distinct elements of each set.
    """
    sizes = np.bincount(of, minlength=n_sets).astype(np.int64)
    own = np.frexp(np.maximum(sizes, 1))[1].astype(np.int64) - 1
    for step in (0, 1):
        band = own + step
        reach = (sizes > 0) & (sizes * 100 // percent >= (1 << band))
        if not reach.any():
            continue
        k = band_limits(sizes, band, percent)
        for level in (1, 2):
            ids = np.flatnonzero(reach)
            if not len(ids):
                break
            index = np.full(n_sets, -1)
            index[ids] = np.arange(len(ids))
            take = reach[of]
            v, o = value[take], index[of[take]]
            salt = 0x9E3779B97F4A7C15 ^ (level << 8)
            if level == 1:
                need = k[ids] // 2 + 1
                sig, who, place, good, passed = partition_signatures(v, o, band[ids], need, salt, percent)
                spare = passed - need
                yield sig, ids[who], band[ids[who]], np.where(good, place, -1), spare[who]
                reach[ids[spare >= 0]] = False
            else:
                sig, who = single_signatures(v, o, band[ids], k[ids] + 1, salt)
                yield sig, ids[who], band[ids[who]], np.full(len(sig), -1), np.full(len(sig), -1)


class Passed:
    """Which rows of a signature a task need not send: it has sent ``most`` others.

    Of each signature in a table of fixed size the rows sent are counted; a signature that
    has lost its place to another is counted afresh.
    """

    def __init__(self, most: int, places: int = 1 << 18):
        self.most, self.sig, self.sent = most, np.zeros(places, np.uint64), np.zeros(places, np.int64)

    def keep(self, sig: np.ndarray) -> np.ndarray:
        """Positions of the rows to send."""
        order = np.argsort(sig)
        ranked = sig[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(first, append=len(sig))
        place = (ranked[first] % np.uint64(len(self.sig))).astype(np.int64)
        before = np.where(self.sig[place] == ranked[first], self.sent[place], 0)
        number = np.arange(len(sig)) - np.repeat(first, size) + np.repeat(before, size)
        self.sig[place], self.sent[place] = ranked[first], before + size
        return order[number < self.most]


def signature_rows(docs: DataFrame, size: int, percent: int, part: int = 0, parts: int = 1, most: int = SHARED) -> DataFrame:
    """``sig long, doc_id long``; of ``parts`` equal parts of all signatures, one.

    Tasks leave out most rows of signatures with over ``most + 1``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = Passed(most + 1)
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(1)):
                value, of = _sets(batch.column(1), a, b, size)
                for sig, who, *_ in signatures(value, of, b - a, percent):
                    on = np.flatnonzero(sig % np.uint64(parts) == part)
                    on = on[passed.keep(sig[on])]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[on].view(np.int64)), pa.array(doc[a:b][who[on]])], ["sig", "doc_id"])
        memory_returned()

    return docs.mapInArrow(run, "sig long, doc_id long")


def shared_signatures(rows: DataFrame, most: int = SHARED) -> DataFrame:
    """``sig, a, b``: the pairs of documents of cold signatures (``sig`` null), and the frequent signatures (``a, b`` null)."""

    def groups(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(edge, append=len(sig))
        frequent = sig[edge[size > most]]
        each = np.repeat(size, size)
        cold = np.flatnonzero((each > 1) & (each <= most))
        sig, doc = sig[cold], doc[cold]
        out = [np.zeros((0, 2), np.int64)]
        for step in range(1, most):
            at = np.flatnonzero(sig[step:] == sig[:-step]) if len(sig) > step else []
            if not len(at):
                break
            two = np.stack([doc[at], doc[at + step]], axis=1)
            out.append(np.sort(two[two[:, 0] != two[:, 1]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        rest = pa.nulls(len(frequent), pa.int64())
        cols = [[pa.nulls(len(pairs), pa.int64()), pa.array(frequent)], [pa.array(pairs[:, 0].copy()), rest], [pa.array(pairs[:, 1].copy()), rest]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["sig", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            sig, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            held.append((sig, doc))
            size += len(sig)
            if size < 500_000:
                continue
            sig, doc = (np.concatenate(c) for c in zip(*held))
            last = int(np.searchsorted(sig, sig[-1]))  # sorted
            if last:
                yield groups(sig[:last], doc[:last])
            held = [(sig[last:][: most + 1], doc[last:][: most + 1])]  # enough to see that it is frequent
            size = len(held[0][0])
        if size:
            yield groups(*(np.concatenate(c) for c in zip(*held)))
        memory_returned()

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "sig long, a long, b long")


def frequent_map(frequent: DataFrame) -> np.ndarray:
    """A bit map of frequent signatures, of fixed size: what it lacks is not frequent."""
    slot, bit = F.pmod("sig", F.lit(_SLOTS)), F.expr("shiftleft(1L, cast(pmod(shiftright(sig, 20), 64) as int))")
    found = frequent.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toPandas()  # _SLOTS rows at most
    out = np.zeros(_SLOTS, dtype=np.int64)
    out[found["slot"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def frequent_rows(docs: DataFrame, frequent: DataFrame, size: int, percent: int) -> DataFrame:
    """``sig, doc_id, open``: frequent signatures that a set has which is not settled (``open``), with all documents."""
    told = docs.sparkSession.sparkContext.broadcast(frequent_map(frequent))
    names = ["sig", "doc_id", "band", "place", "spare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(1)):
                value, of = _sets(batch.column(1), a, b, size)
                for sig, who, *rest in signatures(value, of, b - a, percent):
                    may = (bits[sig & np.uint64(_SLOTS - 1)] >> (sig >> np.uint64(20) & np.uint64(63))) & np.uint64(1)
                    on = np.flatnonzero(may)
                    cols = [sig[on].view(np.int64), doc[a:b][who[on]], *(c[on] for c in rest)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        memory_returned()

    rows = written(docs.mapInArrow(run, ", ".join(f"{n} long" for n in names)).join(frequent, "sig"), "frequent")
    taken = F.count_distinct(F.when(F.col("place") >= 0, F.col("place")))
    short = rows.groupBy("doc_id", "band", "spare").agg(taken.alias("taken")).filter(F.col("taken") > F.col("spare")).select("doc_id", "band", F.lit(True).alias("open")).distinct()
    marked = rows.select("sig", "doc_id", "band").join(short, ["doc_id", "band"], "left").groupBy("sig", "doc_id").agg(F.max(F.coalesce("open", F.lit(False))).alias("open"))
    marked = written(marked, "marked")
    discard(rows)
    return written(marked.join(marked.filter("open").select("sig").distinct(), "sig", "left_semi"), "frequent-rows")


def may_link(x: str, y: str, percent: int) -> F.Column:
    """Whether sizes and sketches of the rows ``x`` and ``y`` allow a link; exact ones always do."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in _WORDS_OF])
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """``a, b, apart``: the pairs that sketches allow; ``apart``: the least share of elements that differ, in millionths."""
    with_a = pairs.join(info.select(F.col("doc_id").alias("a"), F.struct("n_shingles", *_WORDS_OF).alias("x")), "a")
    both = with_a.join(info.select(F.col("doc_id").alias("b"), F.struct("n_shingles", *_WORDS_OF).alias("y")), "b").filter(may_link("x", "y", percent))
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in _WORDS_OF])
    coarse = both.groupBy("a", "b").agg(F.min((apart * 1_000_000 / (F.col("x.n_shingles") + F.col("y.n_shingles"))).cast("int")).alias("apart"))
    return narrowed(coarse, info, percent)


def narrowed(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b, apart)`` that the wide sketches allow, with these for ``apart`` where they tell more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False) + batch.column(5).to_numpy(zero_copy_only=False)
            differ = cells_apart(batch.column(4), batch.column(6))
            keep = np.flatnonzero(differ * (100 + percent) <= n * (100 - percent))
            apart = np.maximum(batch.column(2).to_numpy(zero_copy_only=False)[keep], differ[keep] * 1_000_000 // n[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(apart, pa.int32())], ["a", "b", "apart"])
        memory_returned()

    with_a = pairs.select("a", "b", "apart").join(info.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("wide").alias("w")), "a")
    both = with_a.join(info.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("wide").alias("v")), "b")
    found = both.select("a", "b", "apart", "n", "w", "m", "v").mapInArrow(run, "a long, b long, apart int")
    return found.groupBy("a", "b").agg(F.min("apart").alias("apart"))


def cells_apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many cells the wide sketches of each row differ, the wider folded to the other's size; 0 where one is empty."""
    (raw_x, at_x), (raw_y, at_y) = text_bytes(x), text_bytes(y)
    size_x, size_y = np.diff(at_x) // 8, np.diff(at_y) // 8
    out = np.zeros(len(x), dtype=np.int64)
    some = np.flatnonzero((size_x > 0) & (size_y > 0))
    if not len(some):
        return out
    size = np.minimum(size_x, size_y)[some]
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    bits = np.zeros(len(within), dtype=np.uint64)
    for raw, at, whole in ((raw_x, at_x, size_x), (raw_y, at_y, size_y)):
        eight = np.frombuffer(raw.tobytes(), "<u8")
        start, folds = at[:-1][some] // 8, whole[some] // size
        for fold in range(int(folds.max())):
            on = np.repeat(folds > fold, size)
            bits[on] ^= eight[(np.repeat(start + fold * size, size) + within)[on]]
    out[some] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    return out


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the written pairs ``(a, b)`` that link, by their texts in ``docs``.

    Texts travel, not sets: they are shorter and compress.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                sides = []
                for column in (2, 3):
                    value, of = _sets(batch.column(column), start, stop, size)
                    edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=stop - start))]).tolist()
                    sides.append([value[x:y] for x, y in zip(edge, edge[1:])])
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)]
                link = [c * 100 >= (len(x) + len(y) - c) * percent for x, y, c in zip(*sides, common)]
                yield batch.select([0, 1]).slice(start, stop - start).filter(pa.array(link, pa.bool_()))
        memory_returned()

    texts = docs.select("doc_id", "text")
    first = texts.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    second = texts.join(pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return written(joined.mapInArrow(run, "a long, b long").distinct(), "links")


def linked(pairs: DataFrame, edges: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``edges`` with the links among ``pairs (a, b, apart)`` that change components.

    Each document is first compared with the one that its sketch is nearest to, then
    only pairs of different components are.
    """
    best = pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    best = written(best, "best")
    if best.isEmpty():
        return edges
    edges = edges.unionByName(verified(best, docs, size, percent))
    names = components(edges)
    rest = _named(_named(pairs, names, "a", "of_a"), names, "b", "of_b").filter(F.col("of_a") != F.col("of_b")).select("a", "b")
    rest = written(rest.join(best, ["a", "b"], "left_anti"), "rest")
    return edges.unionByName(verified(rest, docs, size, percent))


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, shared: int = SHARED) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per document.

    ``component_id`` is the smallest ``doc_id`` that links reach.  A null, empty or
    blank text has no shingles and links with nothing; a text of fewer than
    ``size`` words is one shingle.  Rows with a null ``doc_id`` are returned with a
    null component and link with nothing; repeated rows are returned as often as
    they stand; of several texts with one ``doc_id``, all link under that id.  An
    empty table gives no rows; other columns are ignored.
    """
    docs = texts_of(docs)
    with scope() as keep:
        sketched = written(sketches(docs, size), "sketches")
        sizes = keep(written(sketched.select("doc_id", "n_shingles"), "sizes"))
        live = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        firsts = written(live.groupBy("key1", "key2").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")), "firsts")
        # copies of a set link with the first of them
        copied = live.join(firsts.filter(F.col("copies") > 1), ["key1", "key2"]).select("a", F.col("doc_id").alias("b")).filter(F.col("a") != F.col("b"))
        edges = written(copied.distinct(), "copies")
        # a document with a text of its own set goes on; its other texts, if its id stands for several, too
        own = firsts.select(F.col("a").alias("doc_id")).distinct()
        reps = written(docs.join(own, "doc_id", "left_semi"), "firsts-texts")
        info = written(live.join(own, "doc_id", "left_semi").select("doc_id", "n_shingles", *_WORDS_OF, "wide").distinct(), "info")
        discard(sketched)
        groups = reduce(DataFrame.unionByName, [written(shared_signatures(signature_rows(reps, size, percent, part, PARTS, shared), shared), "groups") for part in range(PARTS)])
        cold = groups.filter(F.col("sig").isNull()).select("a", "b").distinct()
        edges = linked(written(possible(cold, info, percent), "pairs", PAIR_ROWS), edges, reps, size, percent)
        hot = frequent_rows(reps, groups.filter(F.col("sig").isNotNull()).select("sig"), size, percent)
        if not hot.isEmpty():
            # the member of each frequent signature that shares most comes first
            weight = hot.groupBy("sig").count()
            score = hot.join(weight, "sig").groupBy("doc_id").agg(F.sum("count").alias("score"))
            leaders = hot.join(score, "doc_id").groupBy("sig").agg(F.max_by(F.struct(F.col("doc_id").alias("leader"), F.col("open").alias("leads")), F.struct("score", -F.col("doc_id"))).alias("l"))
            leaders = written(leaders.select("sig", "l.*"), "leaders")
            led = hot.join(leaders, "sig").filter((F.col("doc_id") != F.col("leader")) & (F.col("open") | F.col("leads")))
            led = led.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
            edges = linked(written(possible(led, info, percent), "led", PAIR_ROWS), edges, reps, size, percent)
            # documents outside their leader's component, with all others
            names = written(components(edges), "names")
            members = written(_named(hot, names, "doc_id", "own").join(info.drop("wide"), "doc_id"), "members")
            centre = _named(leaders, names, "leader", "centre").select("sig", "centre")
            outside = written(members.join(centre, "sig").filter(F.col("own") != F.col("centre")).drop("centre"), "outside")
            met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.own") != F.col("y.own")) & may_link("x", "y", percent)
            some = [(outside.filter("open"), members), (outside.filter("not open"), members.filter("open"))]
            rest = [x.alias("x").join(y.alias("y"), met).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")) for x, y in some]
            rest = narrowed(rest[0].union(rest[1]).distinct().withColumn("apart", F.lit(0)), info, percent)
            edges = edges.unionByName(verified(written(rest, "rest", PAIR_ROWS), reps, size, percent))
        names = keep(written(components(edges), "components"))
    return _named(sizes.select("doc_id", "n_shingles"), names, "doc_id", "component_id")


def _named(rows: DataFrame, names: DataFrame, of: str, name: str) -> DataFrame:
    """``rows`` with the component of a column; without links a document is its own."""
    known = names.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return rows.join(known, rows[of] == known["_node"], "left").withColumn(name, F.coalesce("_component", of)).drop("_node", "_component")


def first_documents(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, shared: int = SHARED) -> DataFrame:
    """The rows of ``docs``, unchanged, without those that links lead to a smaller ``doc_id``.

    Of each group the document with the smallest id stays, with all rows that have
    this id; texts without words and rows with a null ``doc_id`` stay.
    """
    with scope() as keep:
        found = jaccard_components(docs, size, percent, shared)
        later = keep(written(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "later"))
    return docs.join(later, docs["doc_id"].cast("long") == later["doc_id"], "left_anti")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents, five words, three quarters."""
    return jaccard_components(table(spark, sf_dir, "documents"))
