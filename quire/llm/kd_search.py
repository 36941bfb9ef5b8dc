"""Operator 6: exact top-k search with a KD-tree for each shard.

Vectors are turned into integers.  Shards are dealt by median splits of a bounded
sample, so that each holds a region, and a region with more rows than a shard has
several.  Every shard builds a tree by median splits and keeps a tight bounding box
for each node; the largest inner product that a box allows bounds what its vectors
can score.  Nodes are visited best bound first, and a shard is left when no bound
reaches the query's kth score.  That score is first found in a shard of the query's
own region; only shards whose own box may reach it get the query at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import table, written
from quire.llm.vectors import BLOCK, FOUND, blocks, counted, top, unpack, usable

LEAF = 256
BLOCK_ROWS, QUERY_ROWS = 16384, 512
#: Vectors that the splits between shards are taken from.
SAMPLE_ROWS = 8192
NONE = -(2**63)


class KDTree:
    """Median splits along the widest side; leaves of at most ``leaf`` vectors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.perm = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int]] = []  # start, end, left child (right is next to it) or -1
        low, high = [], []
        waiting = []
        if len(ids):
            self.nodes.append((0, len(ids), -1))
            waiting.append(0)
        while waiting:
            k = waiting.pop()
            start, end, _ = self.nodes[k]
            some = data[self.perm[start:end]]
            lo, hi = some.min(axis=0), some.max(axis=0)
            for box, v in ((low, lo), (high, hi)):
                box.extend([None] * (k + 1 - len(box)))
                box[k] = v
            side = int(np.argmax(hi - lo))
            if end - start > leaf and hi[side] > lo[side]:
                mid = (end - start) // 2
                self.perm[start:end] = self.perm[start:end][np.argpartition(some[:, side], mid)]
                left = len(self.nodes)
                self.nodes[k] = (start, end, left)
                self.nodes += [(start, start + mid, -1), (start + mid, end, -1)]
                waiting += [left, left + 1]
        self.low, self.high = (np.array(low), np.array(high)) if low else (data[:0], data[:0])
        self.ids, self.data = ids[self.perm], data[self.perm]

    def search(self, query: np.ndarray, k: int, floor: int = NONE, own: int = -1) -> tuple[list[tuple[int, int, int]], int]:
        """Up to ``k`` of (score, vec_id, position) not below ``floor``, best first, and how many leaves were read.

        Positions are those of the arrays the tree was built from; that of ``own`` is left out.

        Vectors outside the best ``k`` may be missing only if they score less than the
        kth or tie with a larger id.
        """
        if not self.nodes:
            return [], 0
        bound = (np.maximum(query, 0) * self.high + np.minimum(query, 0) * self.low).sum(axis=1).tolist()
        best: list[tuple[int, int]] = []
        heap, leaves = [(-bound[0], 0)], 0
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            start, end, left = self.nodes[node]
            if left >= 0:
                for c in (left, left + 1):
                    if bound[c] >= floor:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            leaves += 1
            score = self.data[start:end] @ query
            at = np.flatnonzero(score >= floor)
            best += [(int(s), int(i), int(p)) for s, i, p in zip(score[at].tolist(), self.ids[start:end][at].tolist(), self.perm[start:end][at].tolist()) if p != own]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
            if len(best) == k:
                floor = max(floor, best[-1][0])
        return best, leaves


def quantised(data: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integers, held in doubles while all products are exact there."""
    v = np.floor(scale * data)
    most = float(np.abs(v).max(initial=0))
    return v if most * most * v.shape[1] < 2**52 else v.astype(np.int64)


def splits(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Median splits as a heap of (side, value), one less than ``leaves``, a power of two."""
    out: list[tuple[int, float]] = []
    parts = [sample]
    while len(out) < leaves - 1:
        after = []
        for p in parts:
            side = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
            value = float(np.median(p[:, side])) if len(p) else 0.0
            out.append((side, value))
            after += [p[p[:, side] < value], p[p[:, side] >= value]]
        parts = after
    return out


def regions(rows: DataFrame, heaps: dict[int, list[tuple[int, float]]]) -> DataFrame:
    """``rows`` of :func:`quire.llm.vectors.counted` with ``region``, the leaf of its dimension's splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index("embedding"))
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            region = np.zeros(len(size), dtype=np.int32)
            for dim in np.unique(size).tolist():
                some, heap = np.flatnonzero(size == dim), heaps.get(dim, [])
                if heap:
                    side, value = np.array([x for x, _ in heap]), np.array([x for _, x in heap])
                    at = np.zeros(len(some), dtype=np.int64)
                    while at.min() < len(heap):
                        at = 2 * at + 1 + (flat[first[some] + side[at]] >= value[at])
                    region[some] = at - len(heap)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, kinds + ", region int")


def boxed(at: DataFrame, scale: int) -> DataFrame:
    """The blocks with ``low`` and ``high``, the corners of their bounding boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                v = np.floor(scale * unpack(row)[3])
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (v.min(axis=0), v.max(axis=0)))], [*batch.schema.names, "low", "high"])

    return at.mapInArrow(run, BLOCK + ", low binary, high binary")


ASK = "dim int, q_block int, q_ids binary, q_keys binary, q_times binary, q_data binary"


def exact_top(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score long, query_key``: the ``k`` vectors of largest integer inner product.

    Both tables have ``vec_id`` and ``embedding``; components become
    ``floor(scale * x)``.  Every row but the query's own may be found, rows with the
    query's id too; equal queries count once, and different ones with the same id differ
    in ``query_key``, a hash of the vector.  Vectors that are null or
    hold null or non-finite components take no part, nor do vectors of another
    dimension than the query's; ties go to the smaller id; fewer vectors, fewer
    rows; other columns are ignored.  Scores must fit 64 bits.
    """
    vectors, queries = usable(vectors, zero=True), usable(queries, zero=True)
    rows = written(counted(vectors), "counted")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    heaps = {}
    for dim, n in sizes.items():
        leaves = 1 << max(0, (n // block_rows).bit_length() - 1)
        if leaves > 1:
            some = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "key")).limit(SAMPLE_ROWS)
            heaps[dim] = splits(np.array([r[0] for r in some.select("embedding").collect()]), min(leaves, SAMPLE_ROWS // 4))

    def bound(q_data: np.ndarray, row: dict) -> np.ndarray:
        low, high = (np.frombuffer(row[c], "<f8") for c in ("low", "high"))
        q = np.floor(scale * q_data)
        most = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
        return most + np.abs(most) * 1e-9 + 1  # sums of doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["dim"], row["block"])
                ids, keys, times, data = unpack(row)
                if kept[0] != key:
                    kept = (key, KDTree(ids, quantised(data, scale)))
                q_ids, q_keys, _, q_data = unpack(row, "q_")
                floors = np.frombuffer(row["floors"], "<i8") if row["floors"] else np.full(len(q_ids), NONE)
                tree, out = kept[1], []
                exact = quantised(q_data, scale)
                if exact.dtype != tree.data.dtype:
                    exact, tree = exact.astype(np.int64), KDTree(ids, quantised(data, scale).astype(np.int64))
                may = np.flatnonzero(bound(q_data, row) >= floors) if row["floors"] else np.arange(len(q_ids))
                for q in may.tolist():
                    own = np.flatnonzero((ids == q_ids[q]) & (keys == q_keys[q]) & (times == 1))
                    for s, i, p in tree.search(exact[q], k, int(floors[q]), int(own[0]) if len(own) else -1)[0]:
                        n = int(times[p]) - (ids[p] == q_ids[q] and keys[p] == q_keys[q])
                        out.append((int(q_ids[q]), int(q_keys[q]), i, s, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "query_key", "vec_id", "score", "times"])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, row in enumerate(batch.to_pylist()):
                known = {(x["query_id"], x["query_key"]): x["floor"] for x in row["kth"] or []}
                pairs = zip(np.frombuffer(row["q_ids"], "<i8").tolist(), np.frombuffer(row["q_keys"], "<i8").tolist())
                raw = np.array([known.get(p, NONE) for p in pairs], "<i8").tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(n, 1) for c in range(6)), pa.array([raw], pa.binary())], [*(c.split()[0] for c in ASK.split(", ")), "floors"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            on = [bool((bound(unpack(r, "q_")[3], r) >= np.frombuffer(r["floors"], "<i8")).any()) for r in rows]
            yield batch.select(["dim", "q_block", "block"]).filter(pa.array(on, pa.bool_()))

    found = FOUND.format("long")
    # a region's rows in as many shards as it needs, a region's queries likewise
    placed = regions(rows, heaps)
    asked = regions(counted(queries), heaps)

    def dealt(df: DataFrame, most: int) -> DataFrame:
        n = df.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("n"))
        salted = df.join(n, ["dim", "region"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "key"), F.col("n")).cast("int"))
        first = n.select("dim", "region", "n", (F.sum("n").over(Window.partitionBy("dim").orderBy("region")) - F.col("n")).alias("first"))
        return salted.join(first.drop("n"), ["dim", "region"]).withColumn("at", F.col("first") + F.col("salt"))

    split = dealt(placed, block_rows)
    at = written(boxed(blocks(split, F.col("at")), scale), "vectors")
    home = split.groupBy("dim", "region").agg(F.min("at").cast("int").alias("home"))
    asking = dealt(asked, QUERY_ROWS)
    q_home = asking.select("dim", F.col("at").cast("int").alias("q_block"), "region").distinct().join(home, ["dim", "region"], "left").drop("region")
    ask = written(blocks(asking, F.col("at")).select("dim", F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "times", "data"))), "queries")
    homes = written(q_home.withColumn("block", F.coalesce("home", F.lit(0))).select("dim", "q_block", "block"), "homes")
    own = written(at.join(ask.join(homes, ["dim", "q_block"]).withColumn("floors", F.lit(None).cast("binary")), ["dim", "block"]).mapInArrow(run, found), "home")
    kth = top(own, k).filter(F.col("rank") == k).select("query_id", "query_key", F.col("score").alias("floor"))
    blocks_of = asking.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), "dim", F.col("at").cast("int").alias("q_block"))
    told = kth.join(blocks_of, ["query_id", "query_key"]).groupBy("dim", "q_block").agg(F.collect_list(F.struct("query_id", "query_key", "floor")).alias("kth"))
    told = ask.join(told, ["dim", "q_block"], "left").select(*(c.split()[0] for c in ASK.split(", ")), "kth").mapInArrow(floors, ASK + ", floors binary")
    told = written(told, "told")
    # the stated queries, by blocks, against the boxes of the shards
    boxes = at.select("dim", "block", "low", "high").join(told.select("dim", "q_block"), "dim").join(homes.withColumn("mine", F.lit(True)), ["dim", "q_block", "block"], "left").filter(F.col("mine").isNull()).drop("mine")
    pairs = boxes.join(told, ["dim", "q_block"]).mapInArrow(reached, "dim int, q_block int, block int")
    rest = at.join(pairs.join(told, ["dim", "q_block"]), ["dim", "block"]).mapInArrow(run, found)
    return top(own.unionByName(rest), k)


def op6_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: ids divisible by 50 against all rows, 5 best, components times 256."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)
