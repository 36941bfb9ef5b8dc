"""Full-text search by an inverted index that is stored as Parquet tables.

``postings`` has a row for each term of each text (term, keys, count, length of the text),
in folders by a hash of the term and sorted by term, so that a search opens the
folders of its terms and skips row groups of other terms.  A folder with very frequent
terms is dealt into as many files as its size asks for.  ``terms`` has the number of texts of each
term, in the same folders; ``totals`` one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import shuffles_freed

K1, B = 1.2, 0.75
#: Folders that terms are dealt into.
PARTS = 32
#: Texts of so many bytes or more are indexed in so many slices.
SLICED_BYTES, SLICES = 32 << 20, 3
#: Terms of all queries that every task holds at most; rows of hits, and scores of texts for queries, that are worked on at once.
MOST_ASKED, ROWS_AT_ONCE, CELLS_AT_ONCE = 500_000, 200_000, 1 << 21


def words_of(*texts: Column) -> Column:
    """The lower-cased runs of letters and digits of all texts, in order; null texts have none."""
    whole = F.concat_ws(" ", *texts)
    return F.filter(F.split(F.lower(whole), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Index:
    """A stored index: where it is, the names and types of the keys, and the number of folders."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    types: tuple[str, ...]
    parts: int

    def table(self, name: str) -> DataFrame:
        keys = ", ".join(f"`{k}` {t}" for k, t in zip(self.keys, self.types))
        columns = {"postings": f"term string, {keys}, tf long, length long, part int", "terms": "term string, df long, part int", "totals": "n long, mean double"}
        return self.spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")


def build(texts: DataFrame, keys: list[str], fields: list[str], path: str, parts: int = PARTS) -> Index:
    """Stores the index of ``texts``; a text is the words of its ``fields``, its ``keys`` name it.

    Texts without words are not in it.  Rows with equal keys are one text.  Texts are
    dealt once by their keys, their counts once by their terms; files are rebalanced by size, so that a frequent term has several.
    """
    spark = texts.sparkSession
    # texts are dealt once; what is counted of one stays where it is
    whole = F.concat_ws(" ", *(F.col(f) for f in fields))
    named = texts.select(*keys, whole.alias("_text")).filter(F.lower("_text").rlike(r"[\p{L}\p{N}]"))

    def rows(some: DataFrame) -> DataFrame:
        dealt = some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        words = dealt.select(*keys, words_of(F.col("_text")).alias("_words"))
        sized = words.select(*keys, "_words", F.sum(F.size("_words").cast("long")).over(Window.partitionBy(*keys)).alias("length"))
        counted = sized.select(*keys, "length", F.explode("_words").alias("term")).groupBy(*keys, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        return counted.select(part_of(F.col("term"), parts).alias("part"), "term", *keys, "tf", "length")

    types = dict(texts.dtypes)
    index = Index(spark, path, tuple(keys), tuple(types[k] for k in keys), parts)
    with shuffles_freed(spark):
        # one part of the texts after the other, so that what is shuffled takes less room at once
        slices = SLICES if int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SLICED_BYTES else 1
        for k in range(slices):
            own = rows(named.filter(F.pmod(F.xxhash64(*keys), F.lit(slices)) == k) if slices > 1 else named)
            own.hint("rebalance", "part").sortWithinPartitions("part", "term").write.mode("append").partitionBy("part").option("compression", "zstd").parquet(f"{path}/postings")
        terms = index.table("postings").groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"))
        terms.hint("rebalance", "part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/terms")
        n = texts.filter(F.lower(whole).rlike(r"[\p{L}\p{N}]")).select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))
        total = index.table("postings").agg(F.sum("tf").alias("all"))
        n.crossJoin(total).select("n", F.try_divide("all", "n").cast("double").alias("mean")).write.parquet(f"{path}/totals")
    return index


def _only(index: Index, terms: list[str]) -> Column:
    """The terms and their folders; the folders are constants, so others are not opened."""
    part = F.lit(False)
    for t in terms:
        part = part | (F.col("part") == part_of(F.lit(t), index.parts))
    return part & F.col("term").isin(terms)


def _score(df: Column, tf: Column, length: Column, n: Column, mean: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search(index: Index, terms: list[str], k: int, every: bool = True, where: Column | None = None) -> DataFrame:
    """``rank, <keys>, score``: the ``k`` best texts with all (or any) of the terms, by BM25; ties by the keys.

    ``where``: a condition on the keys, such as one work.  Terms are compared lower-cased; a term given twice is one;
    no terms, no rows.  Scores are rounded to six digits, so that the order does not hang on the order of sums.
    """
    terms = sorted({t.lower() for t in terms})
    if not terms:
        terms, every = [""], False
    hits = index.table("postings").filter(_only(index, terms))
    if where is not None:
        hits = hits.filter(where)
    known = index.table("terms").filter(_only(index, terms)).select("term", "df").crossJoin(F.broadcast(index.table("totals")))
    # one row for each term of the query
    scored = hits.join(F.broadcast(known), "term")
    found = scored.groupBy(*index.keys).agg(F.round(F.sum(_score(F.col("df"), F.col("tf"), F.col("length"), F.col("n"), F.col("mean"))), 6).alias("score"), F.count(F.lit(1)).alias("held"))
    if every:
        found = found.filter(F.col("held") == len(terms))
    best = found.orderBy(F.col("score").desc(), *index.keys).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.col("score").desc(), *index.keys)).alias("rank"), *index.keys, "score")


def search_many(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``query, rank, <keys>, score``: for each query of ``queries`` (``query``, ``term``) the ``k`` best texts with any of its terms.

    All queries in one job.  Terms are joined with the folders of the index; hits are dealt by text, not by text and query, and
    each text's scores for all queries are summed where its hits are, so that only the ``k`` best of each task are ranked.
    Queries with over :data:`MOST_ASKED` terms in all are summed by a join instead.
    """
    asked = queries.select("query", F.lower("term").alias("term")).dropna().distinct().withColumn("part", part_of(F.col("term"), index.parts))
    if asked.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        known = asked.join(index.table("terms"), ["part", "term"]).crossJoin(F.broadcast(index.table("totals")))
        scored = index.table("postings").join(known, ["part", "term"])
        found = scored.groupBy("query", *index.keys).agg(F.round(F.sum(_score(F.col("df"), F.col("tf"), F.col("length"), F.col("n"), F.col("mean"))), 6).alias("score"))
    else:
        found = _best_by_text(index, asked, k)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), *index.keys)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", *index.keys, "score")


def _best_by_text(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """``query, <keys>, score`` of the ``k`` best texts of each task, and of those that rounding may put among them."""
    pairs = sorted(((r.term, r.part, r.query) for r in asked.collect()), key=lambda x: x[0])
    names = list(dict.fromkeys(q for _, _, q in pairs))
    number = {q: n for n, q in enumerate(names)}
    # the queries of term i stand from starts[i] to starts[i + 1]
    many = Counter((part, t) for t, part, _ in pairs)
    of = np.array([number[q] for _, _, q in pairs], np.int64)
    starts = np.cumsum([0, *many.values()])
    spark, keys = index.spark, list(index.keys)
    numbered = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(many)], "part int, term string, _term int")
    known = F.broadcast(numbered.join(index.table("terms"), ["part", "term"]).crossJoin(F.broadcast(index.table("totals"))))
    weight = _score(F.col("df"), F.col("tf"), F.col("length"), F.col("n"), F.col("mean"))
    hits = index.table("postings").join(known, ["part", "term"]).select(*keys, "_term", weight.alias("_weight"))
    dealt = hits.repartition(*keys).sortWithinPartitions(*keys, "_term")
    # texts are numbered where they stand: a row is the first of its text if the one before has other keys
    schema = ", ".join(["_query int", *(f"`{key}` {t}" for key, t in zip(keys, index.types)), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(names), k, starts, of)
        for table in _whole_texts(batches, len(keys)):
            best.add(table)
        kept = best.rows()
        yield from pa.Table.from_arrays([kept["_query"], *(kept[key] for key in keys), kept["score"]], names=["_query", *keys, "score"]).to_batches() if kept is not None else []

    found = dealt.mapInArrow(run, schema)
    queries = spark.createDataFrame(list(enumerate(names)), asked.select(F.lit(0).alias("_query"), "query").schema)
    return found.join(F.broadcast(queries), "_query").select("query", *keys, F.round("score", 6).alias("score"))


def _whole_texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Rows with a column ``_first``, whether a row begins another text; each table has whole texts."""
    rest: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rest.append(batch)
        size += batch.num_rows
        if size < ROWS_AT_ONCE:
            continue
        table = _marked(pa.Table.from_batches(rest), n)
        last = int(np.flatnonzero(table["_first"].to_numpy())[-1])
        if last:
            yield table.slice(0, last)
        rest = table.slice(last).drop_columns(["_first"]).combine_chunks().to_batches()
        size = table.num_rows - last
    if size:
        yield _marked(pa.Table.from_batches(rest), n)


def _marked(table: pa.Table, n: int) -> pa.Table:
    first = np.ones(table.num_rows, bool)
    same = np.ones(max(table.num_rows - 1, 0), bool)
    for c in table.columns[:n]:
        a, b = c.slice(0, max(len(c) - 1, 0)), c.slice(1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same &= equal.to_numpy().astype(bool)
    first[1:] = ~same
    return table.append_column("_first", pa.array(first))


class _Best:
    """For each query the best texts so far; texts come in the order of their keys."""

    def __init__(self, queries: int, k: int, starts: np.ndarray, of: np.ndarray):
        self.queries, self.k, self.starts, self.of = queries, k, starts, of
        self.found: list[pa.Table] = []
        self.least = np.full(queries, -np.inf)

    def add(self, table: pa.Table) -> None:
        first = np.flatnonzero(table["_first"].to_numpy())
        texts = np.cumsum(table["_first"].to_numpy()) - 1
        terms, weights = table["_term"].to_numpy(), table["_weight"].to_numpy()
        step = max(1, CELLS_AT_ONCE // max(self.queries, 1))
        for low in range(0, len(first), step):
            high = min(low + step, len(first))
            rows = slice(first[low], first[high] if high < len(first) else len(terms))
            t, w, text = terms[rows], weights[rows], texts[rows] - low
            count = self.starts[t + 1] - self.starts[t]
            end = np.cumsum(count)
            place = np.arange(end[-1] if len(end) else 0) - np.repeat(end - count, count) + np.repeat(self.starts[t], count)
            cell = self.of[place] * (high - low) + np.repeat(text, count)
            scores = np.bincount(cell, np.repeat(w, count), self.queries * (high - low)).reshape(self.queries, high - low)
            self._take(scores, table, first[low:high])

    def _take(self, scores: np.ndarray, table: pa.Table, first: np.ndarray) -> None:
        queries, places, values = [], [], []
        for q in np.flatnonzero((scores.max(axis=1) >= self.least) & (scores.max(axis=1) > 0)):
            own = scores[q]
            at = np.flatnonzero((own > 0) & (own >= self.least[q]))
            if len(at) > self.k:
                # what rounding to six digits can bring up to the k-th stays, of equal scores the first k
                bound = np.partition(own[at], len(at) - self.k)[len(at) - self.k]
                self.least[q] = max(self.least[q], bound - 2e-6)
                at = at[own[at] >= bound - 2e-6]
                order = at[np.argsort(own[at], kind="stable")]
                new = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
                rank = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
                at = order[rank < self.k]
            queries.append(np.full(len(at), q, np.int32))
            places.append(first[at])
            values.append(own[at])
        if queries:
            rows = table.take(pa.array(np.concatenate(places))).drop_columns(["_term", "_weight", "_first"])
            self.found.append(rows.append_column("_query", pa.array(np.concatenate(queries))).append_column("score", pa.array(np.concatenate(values))))

    def rows(self) -> pa.Table | None:
        if not self.found:
            return None
        table = pa.concat_tables(self.found)
        return table.filter(pa.array(table["score"].to_numpy() >= self.least[table["_query"].to_numpy()]))
