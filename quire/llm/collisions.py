"""Operator 1: approximate nearest neighbours by collision counting.

Every block of vectors keeps one sorted array for each of ``projections`` random
directions.  Around a query's own projection a window is opened in each array
and widened level by level (virtual rehashing); a vector collides with the query
once for each array in which it lies inside the window, whose ends are taken to whole
cells of the array.  Vectors that collide in
more than a set share of the arrays are candidates; widening ends when there are
enough of them, and they are verified by their exact inner product.

For inner products, each block lifts its vectors by one coordinate to equal
norms, which makes the nearest vector in the lifted space the one with the
largest product.  A query therefore needs no global statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import table
from quire.llm.vectors import FOUND, blocks, counted, others, top, unpack, usable

PROJECTIONS = 512
#: Of the arrays, the share in which a candidate must collide.
THRESHOLD = 0.6
#: Candidates to verify: this share of a block, and 4 k at least.
SHARE = 0.05
#: First window as a share of the block's standard deviation along a direction, and the factor of each level.
FIRST, WIDER = 0.6, 1.05
BLOCK_ROWS, QUERY_ROWS = 16384, 1024
#: Windows end at whole cells, of which an array has so many; arrays that are compared together.
CELLS, TOGETHER = 256, 32


class CollisionIndex:
    """Sorted projections of a block."""

    def __init__(self, data: np.ndarray, projections: int, seed: int = 1):
        norms = (data * data).sum(axis=1)
        lifted = np.hstack([data, np.sqrt(np.maximum(0, norms.max(initial=0) - norms))[:, None]])
        self.directions = np.random.default_rng([seed, data.shape[1]]).standard_normal((lifted.shape[1], projections))
        self.data = data
        values = (lifted @ self.directions).T
        n = len(data)
        order = np.argsort(values, axis=1, kind="stable")
        ordered = np.take_along_axis(values, order, axis=1)
        self.first = FIRST * max(float(values.std()), 1e-12)
        self.widest = float(np.abs(values).max(initial=0)) if len(data) else 0.0
        # the cell of each vector in each array; windows are about half an array, so comparing cells beats reading them
        cell = np.arange(n) * CELLS // max(1, n)
        self.cells = np.empty((projections, n), dtype=np.uint8)
        np.put_along_axis(self.cells, order, cell.astype(np.uint8)[None], axis=1)
        # first and last values of the cells, end to end, each array moved past the one before: one search finds all windows
        self.apart = 3 * self.widest + 1
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        self.number, self.at_cell = len(begins), cell[begins].astype(np.uint8)
        base = np.arange(projections)[:, None] * self.apart
        self.firsts = (ordered[:, begins] + base).reshape(-1)
        self.lasts = (ordered[:, np.append(begins[1:], n) - 1] + base).reshape(-1)
        self.hint = 0

    def candidates(self, query: np.ndarray, wanted: int, threshold: float) -> np.ndarray:
        """Positions of vectors that collide often enough, at least ``wanted`` if there are so many."""
        n, m = self.cells.shape[::-1]
        if wanted >= n:
            return np.arange(n)
        at = np.append(query, 0.0) @ self.directions
        need = max(1, int(np.ceil(threshold * m)))
        far = self.widest + float(np.abs(at).max())
        # beyond the last level a window holds its whole array
        last = max(0, int(np.ceil(np.log(max(far / self.first, 1)) / np.log(WIDER)))) + 1
        # windows of a level hold those of the levels before, so the first that is wide enough can be searched for from any
        low, high, best, level, step = -1, last + 1, None, min(self.hint, last), 1
        while high - low > 1:
            found = np.flatnonzero(self.collisions(at, self.first * WIDER**level) >= need)
            if len(found) >= wanted or level == last:
                high, best = level, found
                level = max(low + 1, high - step) if low < 0 else (low + high) // 2
            else:
                low = level
                level = min(last, low + step) if high > last else (low + high) // 2
            step *= 2
        self.hint = high
        return best

    def collisions(self, at: np.ndarray, width: float) -> np.ndarray:
        """In how many arrays each vector lies in the window about ``at``, ends taken to whole cells."""
        # a window never needs to leave the span of its array's values
        reach = self.widest * 1.001
        base, place = np.arange(len(at)) * self.apart, np.arange(len(at)) * self.number
        a = np.searchsorted(self.lasts, np.clip(at - width, -reach, reach) + base) - place
        b = np.searchsorted(self.firsts, np.clip(at + width, -reach, reach) + base, side="right") - place
        cells, some = self.cells, np.flatnonzero(b > a)
        if len(some) < len(at):
            cells, a, b = cells[some], a[some], b[some]
        low = self.at_cell[a]
        span = self.at_cell[b - 1] - low
        counts = np.zeros(len(self.data), dtype=np.uint16)
        moved, inside = np.empty((TOGETHER, len(counts)), np.uint8), np.empty((TOGETHER, len(counts)), bool)
        for k in range(0, len(cells), TOGETHER):
            n = len(low[k : k + TOGETHER])
            # cells below the window wrap round
            np.subtract(cells[k : k + n], low[k : k + n, None], out=moved[:n])
            np.less_equal(moved[:n], span[k : k + n, None], out=inside[:n])
            counts += np.add.reduce(inside[:n].view(np.uint8), axis=0, dtype=np.uint8)
        return counts

    def search(self, query: np.ndarray, wanted: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and their exact inner products."""
        at = self.candidates(query, wanted, threshold)
        return at, np.einsum("ij,j->i", self.data[at], query)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, projections: int = PROJECTIONS, threshold: float = THRESHOLD, share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score, query_key``: the ``k`` nearest vectors found for each query.

    Both tables have ``vec_id`` and ``embedding``.  Every row but the query's own may be
    found, rows with the query's id too; equal queries count once, and different ones
    with the same id differ in ``query_key``, a hash of the vector.
    Vectors that are null, zero or hold null or non-finite components take no part,
    nor do vectors of another dimension than the query's; ties go to the smaller id;
    no vectors, no rows; other columns are ignored.
    """
    vectors, queries = usable(vectors, zero=False), usable(queries, zero=False)
    blocks_n = max(1, -(-vectors.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys, times, data = unpack(row)
                if kept[0] != (row["dim"], row["block"]):
                    kept = ((row["dim"], row["block"]), CollisionIndex(data, projections))
                index = kept[1]
                wanted = max(4 * k, int(share * len(ids)))
                q_ids, q_keys, _, q_data = unpack(row, "q_")
                out = []
                for q, key, v in zip(q_ids.tolist(), q_keys.tolist(), q_data):
                    at, score = index.search(v, wanted, threshold)
                    n = others(ids[at], keys[at], times[at], q, key)
                    best = np.lexsort((ids[at], -score))
                    best = best[n[best] > 0][:k]
                    out.append((np.full(len(best), q), np.full(len(best), key), ids[at][best], score[best], n[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "query_key", "vec_id", "score", "times"])

    at = blocks(counted(vectors), F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks_n)))
    ask = blocks(counted(queries), F.pmod(F.xxhash64("vec_id", "key"), F.lit(query_blocks)))
    ask = ask.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1))).alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "times", "data")))
    pairs = at.join(ask, ["dim", "block"])
    return top(pairs.mapInArrow(run, FOUND.format("double")), k)


def op1_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: ids divisible by 20 against all rows, 20 nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
