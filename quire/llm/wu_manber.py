"""Operator 12: benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of consecutive words of the benchmark's items, texts are
sequences of words.  For the patterns of one length a shift table tells for each
hashed block of words how far the search may move on; where it says zero, the
block's bucket of patterns with that suffix is looked up, those whose other words
have the text's hash are selected, and their letters are compared with the text's.
Many places of a text are searched at the same time, each by the same rule.

A benchmark under a stated size goes to every task.  A larger one is dealt into
blocks; texts meet each block once and what was found is put together by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import table, texts_of
from quire.llm.tokens import Words, byte_set, gathered, strings
from quire.llm.words import mix, slices, text_bytes

WINDOW = 10
#: Words of a block of the shift table.
BLOCK_WORDS = 2
#: A benchmark with at most so many windows, and so many bytes of them, goes to every task; a block of a larger one has as many.
BLOCK_WINDOWS, BLOCK_BYTES = 1 << 17, 1 << 25
#: What separates words, after A-Z are lower-cased: all of ASCII but digits and letters.
APART = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Texts are searched in parts of about so many bytes, one text at least; a search begins at every so many words.
SLICE, LANE = 1 << 20, 64

FOUND = "doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def run_hash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each of ``at``."""
    out = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _ODD[0] + hashes[at + k] * _ODD[1])
    return out


class _Length:
    """Tables for all patterns of ``m`` words."""

    def __init__(self, words: Words, first: np.ndarray, patterns: np.ndarray, m: int):
        self.m, self.size = m, min(BLOCK_WORDS, m)
        self.bits = int(np.clip(np.ceil(np.log2(8 * m * len(first) + 1)), 10, 24))
        self.shift = np.full(1 << self.bits, m - self.size + 1, dtype=np.int64)
        for end in range(self.size, m + 1):  # later blocks allow smaller shifts
            self.shift[self.slot(run_hash(words.hashes, first + end - self.size, self.size))] = m - end
        self.suffix = run_hash(words.hashes, first + m - self.size, self.size)
        self.key = self.keys(self.suffix, run_hash(words.hashes, first, m - self.size))
        order = np.argsort(self.key, kind="stable")
        self.key, self.patterns = self.key[order], patterns[order]
        self.suffix = np.sort(self.suffix)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def keys(suffix: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return mix(suffix * _ODD[0] + rest * _ODD[1])

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray, int]:
        """Places where a pattern may start, with the pattern, and how many places were looked at."""
        n, m, size = len(words), self.m, self.size
        end = np.arange(m - 1, n, LANE)
        stop = np.minimum(end + LANE, n)
        ends, blocks, seen = [], [], 0
        while len(end):
            seen += len(end)
            block = run_hash(words.hashes, end - size + 1, size)
            shift = self.shift[self.slot(block)]
            zero = shift == 0
            ends.append(end[zero])
            blocks.append(block[zero])
            end = end + np.maximum(shift, 1)
            on = end < stop
            end, stop = end[on], stop[on]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), seen
        first, block = np.concatenate(ends) - m + 1, np.concatenate(blocks)
        at = np.minimum(np.searchsorted(self.suffix, block), len(self.suffix) - 1)
        some = (self.suffix[at] == block) & (words.rows[first] == words.rows[first + m - 1])
        first, block = first[some], block[some]
        key = self.keys(block, run_hash(words.hashes, first, m - size))
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        many = high - low
        of = np.repeat(np.arange(len(first)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        return first[of], self.patterns[low[of] + nth], seen


class WuManber:
    """All windows of a benchmark, distinct ones once; ``windows`` are their words with one space between."""

    def __init__(self, windows: pa.Array):
        raw, offsets = text_bytes(windows)
        self.words = Words(raw, offsets, APART)
        self.count = np.bincount(self.words.rows, minlength=len(windows))
        self.first = np.cumsum(self.count) - self.count
        last = np.maximum(self.first + self.count - 1, 0)
        self.text, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.words):
            self.text = self.words.starts[np.minimum(self.first, len(self.words) - 1)]
            self.size = self.words.starts[last] + self.words.lengths[last] - self.text
        self.lengths = [_Length(self.words, self.first[at], at, int(m)) for m in np.unique(self.count[self.count > 0]) for at in [np.flatnonzero(self.count == m)]]

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word and window of every occurrence, by ``words``' own numbering."""
        out = [(np.zeros(0, np.int64),) * 3]
        for tables in self.lengths:
            first, pattern, _ = tables.candidates(words)
            last = first + tables.m - 1
            size = words.starts[last] + words.lengths[last] - words.starts[first]
            same = size == self.size[pattern]
            first, last, pattern, size = first[same], last[same], pattern[same], size[same]
            for a in range(0, len(first), 1 << 14):
                some = slice(a, a + (1 << 14))
                mine, ends = gathered(words.letters, words.starts[first[some]], size[some])
                other, _ = gathered(self.words.letters, self.text[pattern[some]], size[some])
                equal = np.logical_and.reduceat(mine == other, ends[:-1])
                out.append((first[some][equal], last[some][equal], pattern[some][equal]))
        return tuple(np.concatenate(c) for c in zip(*out))


class Benchmark:
    """Windows with their items; an item is a string."""

    def __init__(self, windows: pa.Array, items: pa.Array):
        windows, items = windows.dictionary_encode(), items.dictionary_encode()
        self.search = WuManber(windows.dictionary)
        # items numbered in the order of their strings
        names = sorted(range(len(items.dictionary)), key=lambda k: items.dictionary[k].as_py())
        self.items = np.array([items.dictionary[k].as_py() for k in names], dtype=object)
        number = np.empty(len(names), dtype=np.int64)
        number[names] = np.arange(len(names))
        of, item = windows.indices.to_numpy(), number[items.indices.to_numpy()] if len(items) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([of, item], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.item = pairs[:, 1]
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(windows.dictionary) + 1))

    def found(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text its number of words, the merged spans of hit words, and the items."""
        raw, offsets = text_bytes(texts)
        words = Words(raw, offsets, APART)
        n = len(texts)
        count = np.bincount(words.rows, minlength=n)
        before = np.cumsum(count) - count
        first, last, window = self.search.occurrences(words)
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, last + 1, -1)
        hit = np.cumsum(change[:-1]) > 0
        inner = np.zeros(len(hit), dtype=bool)
        inner[1:] = hit[1:] & hit[:-1] & (words.rows[1:] == words.rows[:-1])
        begins = np.flatnonzero(hit & ~inner)
        ends = np.flatnonzero(hit & ~np.append(inner[1:], False)) if len(words) else begins
        rows = words.rows[begins]
        spans = pa.StructArray.from_arrays([pa.array((x - before[rows]).astype(np.int32)) for x in (begins, ends)], ["first", "last"])
        seen = np.unique(np.stack([words.rows[first], window], axis=1), axis=0)
        many = self.start[seen[:, 1] + 1] - self.start[seen[:, 1]]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.stack([np.repeat(seen[:, 0], many), self.item[np.repeat(self.start[seen[:, 1]], many) + nth]], axis=1), axis=0)
        lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32)), v) for r, v in ((rows, spans), (pairs[:, 0], pa.array(self.items[pairs[:, 1]].tolist(), pa.string())))]
        return count, lists[0], lists[1]


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, window``: all windows of ``window`` words of each item; of an item of fewer words, but not none, its one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                words = Words(*text_bytes(batch.column(1).slice(a, b - a)), APART)
                count = np.bincount(words.rows, minlength=b - a)
                before = np.cumsum(count) - count
                nth = np.arange(len(words)) - before[words.rows]
                long = count[words.rows]
                first = np.flatnonzero((nth == 0) | (nth + window <= long))
                last = np.minimum(first + window - 1, (before + count - 1)[words.rows[first]])
                size = words.starts[last] + words.lengths[last] - words.starts[first]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(words.rows[first])), strings(words.letters, words.starts[first], size)], ["item", "window"])

    return items.mapInArrow(run, "item string, window string").distinct()


def _searched(ids: pa.Array, texts: pa.Array, benchmark: Benchmark) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, pa.Array]]:
    for a, b in slices(texts, SLICE):
        yield ids.slice(a, b - a), *benchmark.found(texts.slice(a, b - a))


def benchmark_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items``, one row for each row of ``docs``.

    ``spans`` are the first and last numbers, from 0, of the runs of words that lie inside any
    occurrence of a window of ``benchmark`` (``item_id``, ``text``), in order; ``items``
    the sorted ids, as strings, of the items with an occurring window.  A null text has no
    words; items with a null id or no words do not take part; an item given twice is one; with
    no items nothing is found.  Rows with a null id have a row of their own, as
    repeated rows have.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts, patterns = texts_of(docs), windows_of(benchmark, window)
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_windows), -(-size["bytes"] // block_bytes))
    if blocks == 1:
        few = patterns.toArrow()
        held = spark.sparkContext.broadcast((few["window"].to_pylist(), few["item"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(*(pa.array(x, pa.string()) for x in held.value))
            for batch in batches:
                for ids, count, spans, items in _searched(batch.column(0), batch.column(1), known):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(count), spans, items], ["doc_id", "n_words", "spans", "items"])

        return texts.mapInArrow(run, FOUND)

    # every text meets every block: the blocks come first in each task, the texts behind them
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    dealt = patterns.select(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("window").alias("text"), "item")
    asked = texts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("string").alias("item"))
    meeting = dealt.unionByName(asked).repartition(blocks * salts, "block", "salt").sortWithinPartitions("block", "salt", "kind")
    key = meeting.withColumn("key", F.xxhash64("text"))

    def run_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, windows, items, known = None, [], [], None
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 if len(at) else []
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                if group != tuple(at[a][:2]):
                    group, windows, items, known = tuple(at[a][:2]), [], [], None
                part = batch.slice(a, b - a)
                if at[a][2] == 0:
                    windows.append(part.column(4))
                    items.append(part.column(5))
                    continue
                if known is None:
                    known = Benchmark(*(pa.chunked_array(x, pa.string()).combine_chunks() for x in (windows, items)))
                begin = 0
                for ids, count, spans, names in _searched(part.column(3), part.column(4), known):
                    more = part.slice(begin, len(ids))
                    begin += len(ids)
                    yield pa.RecordBatch.from_arrays([ids, more.column(6), more.column(0), pa.array(count), spans, names], ["doc_id", "key", "block", "n_words", "spans", "items"])

    parts = key.mapInArrow(run_block, FOUND.replace("doc_id long,", "doc_id long, key long, block long,"))
    whole = parts.groupBy("doc_id", "key").agg(F.sum((F.col("block") == 0).cast("long")).alias("times"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    pair = F.struct(F.lit(0).alias("first"), F.lit(-2).alias("last"))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def wider(done: F.Column, span: F.Column) -> F.Column:
        """``done``: the runs so far and the open one."""
        open_, first, last = done["open"], span["first"], span["last"]
        joined = F.struct(done["runs"].alias("runs"), F.struct(open_["first"].alias("first"), F.greatest(open_["last"], last).alias("last")).alias("open"))
        opened = F.struct(F.when(open_["last"] >= 0, F.concat(done["runs"], F.array(open_))).otherwise(done["runs"]).alias("runs"), F.struct(first.alias("first"), last.alias("last")).alias("open"))
        return F.when((open_["last"] >= 0) & (first <= open_["last"] + 1), joined).otherwise(opened)

    merged = F.aggregate("spans", F.struct(none.alias("runs"), pair.alias("open")), wider, lambda d: F.when(d["open"]["last"] >= 0, F.concat(d["runs"], F.array(d["open"]))).otherwise(d["runs"]))
    return whole.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "n_words", merged.alias("spans"), "items")


def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents against all items of ``benchmark``, with digests of what was found."""
    found = benchmark_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
o AS (SELECT rid, item, dw.m, i FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM o)) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)"""
