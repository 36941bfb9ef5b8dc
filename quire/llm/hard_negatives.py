"""Operator 11: hard-negative mining by product quantisation with residual bounds.

A bounded sample gives codebooks for parts of the dimensions; every row is stored in
blocks as its codes, the norm of what the codes leave over in each part, and its integer
vector.  An anchor's table of part products gives each row a score from its codes, and
the anchor's part norms times the stored residual norms bound how far the true score
is off.  Rows whose bounds rule them out are left; all others get their exact integer
score, so that the result is that of a full comparison.

Blocks are met twice: those that hold an anchor's own label for its positives, then all
of them for the windows of scores below those positives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import scope, table, written

#: Rows that the codebooks are fitted on, for each dimension; parts and centroids of the codes.
SAMPLE_ROWS, PARTS, CENTROIDS, ROUNDS = 4096, 16, 64, 6
#: Rows of a block and anchors that meet it at once; groups that labels are dealt into.
BLOCK_ROWS, ANCHOR_ROWS, BUCKETS, STEP = 16384, 512, 64, 32

PLACE = "dim int, bucket int, salt int"
BLOB = "ids binary, keys binary, times binary, labels binary, data binary, codes binary, norms binary, wanted binary"


class ProductQuantiser:
    """Codebooks by k-means in each of ``parts`` slices of the dimensions."""

    def __init__(self, sample: np.ndarray, parts: int = PARTS, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1):
        dim = sample.shape[1]
        self.cuts = np.unique(np.linspace(0, dim, min(parts, dim) + 1).astype(int))
        r = np.random.default_rng(seed)
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            some = np.unique(sample[:, a:b], axis=0)
            book = some[r.permutation(len(some))[:centroids]] if len(some) else np.zeros((1, b - a))
            for _ in range(rounds if len(some) > len(book) else 0):
                near = self.nearest(some, book)
                count = np.bincount(near, minlength=len(book))
                total = np.stack([np.bincount(near, weights=some[:, d], minlength=len(book)) for d in range(b - a)], axis=1)
                book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
            self.books.append(book)

    @staticmethod
    def nearest(data: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.argmin((book * book).sum(axis=1) - 2 * (data @ book.T), axis=1)

    def slices(self, data: np.ndarray) -> list[np.ndarray]:
        return [data[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, and the norms of its residuals, rounded up."""
        codes = np.stack([self.nearest(x, b) for x, b in zip(self.slices(data), self.books)], axis=1)
        left = [np.sqrt(((x - b[c]) ** 2).sum(axis=1)) for x, b, c in zip(self.slices(data), self.books, codes.T)]
        return codes.astype(np.uint8), np.nextafter((np.stack(left, axis=1) * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and row the least and the largest score that its codes allow."""
        score, largest = np.zeros((len(anchors), len(codes))), np.zeros((len(anchors), 1))
        for x, book, code in zip(self.slices(anchors), self.books, codes.T):
            products = x @ book.T
            score += products[:, code]
            largest += np.abs(products).max(axis=1, keepdims=True)
        own = np.stack([np.sqrt((x * x).sum(axis=1)) for x in self.slices(anchors)], axis=1)
        wide = (own @ norms.T.astype(np.float64)) * (1 + 1e-9) + 1e-9 * largest + 1e-6
        return score - wide, score + wide


def exact(data: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles while these are exact."""
    if float(np.abs(data).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**52:
        return (data @ anchor).astype(np.int64)
    return data.astype(np.int64) @ anchor.astype(np.int64)


def kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value, or less than all if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def first_of(score: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Places of the first rows, by score and id, that make up ``k``."""
    order = np.lexsort((ids, -score))[:k]
    return order[np.cumsum(times[order]) - times[order] < k]


class Block:
    """One stored block, or the anchors that meet it."""

    def __init__(self, row: dict):
        self.ids, self.keys, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "keys", "labels"))
        self.data = np.frombuffer(row["data"], "<f8").reshape(-1, row["dim"])
        if row["codes"] is not None:
            self.times = np.frombuffer(row["times"], "<i8")
            self.codes, self.norms = (np.frombuffer(row[c], t).reshape(len(self.ids), -1) for c, t in (("codes", "u1"), ("norms", "<f4")))
        if row["wanted"] is not None:
            self.wanted = np.frombuffer(row["wanted"], "<i8").reshape(len(self.ids), -1, 2)

    def own(self, anchors: Block, at: int) -> np.ndarray:
        return (self.ids == anchors.ids[at]) & (self.keys == anchors.keys[at])


def positives_in(block: Block, anchors: Block, book: ProductQuantiser, k: int) -> Iterator[tuple]:
    """The ``k`` best rows of a block that have the anchor's label: ``at, rows, score, times``."""
    for a in range(0, len(anchors.ids), STEP):
        low, high = book.bounds(anchors.data[a : a + STEP], block.codes, block.norms)
        for q in range(len(low)):
            times = block.times - block.own(anchors, a + q)
            may = np.flatnonzero((block.labels == anchors.labels[a + q]) & (times > 0))
            may = may[high[q][may] >= kth(low[q][may], k)]
            score = exact(block.data[may], anchors.data[a + q])
            best = first_of(score, block.ids[may], times[may], k)
            yield a + q, 0, may[best], score[best], times[may][best]


def negatives_in(block: Block, anchors: Block, book: ProductQuantiser, k: int) -> Iterator[tuple]:
    """The ``k`` best rows of another label inside each window of the anchor: ``at, rank of the window, rows, score, times``."""
    for a in range(0, len(anchors.ids), STEP):
        low, high = book.bounds(anchors.data[a : a + STEP], block.codes, block.norms)
        for q in range(len(low)):
            other = np.flatnonzero(block.labels != anchors.labels[a + q])
            lo, hi = low[q][other], high[q][other]
            for rank, (least, most) in enumerate(anchors.wanted[a + q].tolist(), 1):
                if least > most:
                    continue
                floor = max(least, kth(lo[(lo >= least) & (hi <= most)], k))
                may = other[(hi >= floor) & (lo <= most)]
                score = exact(block.data[may], anchors.data[a + q])
                inside = (score >= least) & (score <= most)
                may, score = may[inside], score[inside]
                best = first_of(score, block.ids[may], block.times[may], k)
                yield a + q, rank, may[best], score[best], block.times[may][best]


FOUND = "anchor_id long, anchor_key long, nth int, vec_id long, score long, times long"


def met(blocks: DataFrame, anchors: DataFrame, books: dict[int, ProductQuantiser], search: Callable, k: int) -> DataFrame:
    """Rows of :data:`FOUND`: every block with the anchors sent to its place, one block in memory at a time."""
    both = blocks.withColumn("kind", F.lit(0)).unionByName(anchors.withColumn("kind", F.lit(1)))
    both = both.repartition("dim", "bucket", "salt").sortWithinPartitions("dim", "bucket", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    place, block = (row["dim"], row["bucket"], row["salt"]), Block(row)
                    continue
                if place != (row["dim"], row["bucket"], row["salt"]):
                    continue  # no such block
                asked = Block(row)
                out = [(np.full(len(rows), asked.ids[at]), np.full(len(rows), asked.keys[at]), np.full(len(rows), nth, np.int32), block.ids[rows], score, times) for at, nth, rows, score, times in search(block, asked, books[row["dim"]], k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [c.split()[0] for c in FOUND.split(", ")])

    return both.mapInArrow(run, FOUND)


def packed(rows: DataFrame, scale: int, books: dict[int, ProductQuantiser] | None, wanted: tuple[int, int, int] | None) -> DataFrame:
    """``PLACE`` and ``BLOB``: rows put together by ``dim, bucket, salt``.

    With ``books`` their codes are stored; with ``wanted`` (number of windows, and their limits in
    per cent) each row's windows, from ``positives``, the scores of its positives.
    """
    columns = ["vec_id", "key", "times", "label", "embedding", *(["positives"] if wanted else [])]
    grouped = rows.groupBy("dim", "bucket", "salt").agg(F.collect_list(F.struct(*columns)).alias("rows"))

    def windows(scores: list[list[int] | None]) -> bytes:
        n, low, high = wanted
        out = np.tile(np.array([1, 0], "<i8"), (len(scores), n, 1))
        for k, mine in enumerate(scores):
            for i, s in enumerate(mine or []):
                least, most = -(-low * s // 100), high * s // 100
                if least <= most:
                    out[k, i] = least, most
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, dim = batch.column(3)[k].values, batch.column(0)[k].as_py()
                ids, keys, times, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "key", "times", "label"))
                order = np.lexsort((keys, ids))
                data = np.floor(scale * rows.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))[order]
                blobs = [x[order].astype("<i8").tobytes() for x in (ids, keys, times, labels)] + [data.astype("<f8").tobytes()]
                blobs += [x.tobytes() for x in books[dim].encode(data)] if books else [None, None]
                blobs.append(windows(rows.field("positives").take(pa.array(order)).to_pylist()) if wanted else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), *(pa.array([x], pa.binary()) for x in blobs)], [c.split()[0] for c in f"{PLACE}, {BLOB}".split(", ")])

    return grouped.mapInArrow(run, f"{PLACE}, {BLOB}")


def counted(vectors: DataFrame, is_anchor: F.Column) -> DataFrame:
    """``vec_id, embedding, label, anchor, times, key, dim, bucket`` of the rows that take part, equal ones once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    big = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound)
    once = rows.groupBy("vec_id", "embedding", "label", "anchor").agg(F.count(F.lit(1)).alias("times"))
    return once.withColumn("key", F.xxhash64("embedding", "label")).withColumn("dim", F.size("embedding")).withColumn("bucket", F.pmod(F.hash("label"), F.lit(BUCKETS)))


def fitted(rows: DataFrame, scale: int, sample_rows: int) -> dict[int, ProductQuantiser]:
    """The codebooks of each dimension, from at most ``sample_rows`` rows of it."""
    out = {}
    for (dim,) in rows.select("dim").distinct().collect():
        some = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "key")).limit(sample_rows).select("embedding").toArrow()
        out[dim] = ProductQuantiser(np.floor(scale * some["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
    return out


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``salt``, so that about ``most`` of them have one ``dim, bucket, salt``."""
    n = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / most).alias("n"))
    return rows.join(n, ["dim", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "key"), F.col("n")).cast("int")).drop("n")


def first_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by score and id, with ``rank``; a row that occurs several times is several."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    few = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    last = F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("last", last).withColumn("first", F.col("last") - F.col("times") + 1).filter(F.col("first") <= k)
    return few.select(*by, F.explode(F.sequence(F.col("first").cast("int"), F.least("last", F.lit(k).cast("long")).cast("int"))).alias("rank"), "vec_id", "score")


def hard_negatives(vectors: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; anchors are the rows where ``is_anchor``
    (a condition on these) holds.  Components become ``floor(scale * x)``; scores are integer
    inner products and must fit 64 bits; ties go to the smaller id.  An anchor's positives are its first ``positives``
    other rows of its label; for each the first ``negatives`` rows of other labels whose score
    is between ``low`` and ``high`` per cent of the positive's, so there are none where that is below zero.
    Rows with a null id, a null label, or a null or empty vector or one with null or non-finite components take no part,
    rows of different dimensions never meet; equal anchor rows count once, and a row that
    occurs several times is found as often; no rows, no result; other columns are ignored.
    The codebooks are fitted on ``sample_rows`` rows of a dimension, which decide nothing but speed.
    """
    rows = counted(vectors, is_anchor)
    with scope() as keep:
        rows = written(rows, "counted")
        books = fitted(rows, scale, sample_rows)
        blocks = written(packed(dealt(rows, block_rows), scale, books, None), "blocks")
        places = blocks.select("dim", "bucket", "salt")
        anchors = rows.filter("anchor")

        # positives: the anchors meet the blocks of their label's bucket
        asked = packed(dealt(anchors, ANCHOR_ROWS), scale, None, None).drop("salt").join(places, ["dim", "bucket"])
        found = met(blocks, asked, books, positives_in, positives)
        mine = written(first_rows(found, ["anchor_id", "anchor_key"], positives), "positives")

        # negatives: each anchor's windows meet all blocks of its dimension
        scores = mine.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives"))
        asked = packed(dealt(anchors.join(scores, ["vec_id", "key"]), ANCHOR_ROWS), scale, None, (positives, low, high)).drop("bucket", "salt").join(places, "dim")
        found = met(blocks, asked, books, negatives_in, negatives)
        best = first_rows(found, ["anchor_id", "anchor_key", "nth"], negatives)
        positive = mine.select("anchor_id", "anchor_key", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        best = best.join(positive, ["anchor_id", "anchor_key", "nth"])
        return keep(written(best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))


def op11_pq_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: anchors are ids divisible by 100; where ids are divisible by 7 the label is moved on by one first."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
