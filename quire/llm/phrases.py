"""Operator 13: phrase mining by suffix arrays over word ids.

Texts are split into pieces and pieces into words.  A shard of texts numbers its
words, ranks all suffixes by prefix doubling as far as phrases go, and reads the
counts of n-grams from the intervals of equal prefixes (LCP intervals); counts of
all shards are merged by language and phrase.

A phrase is as rare as its rarest word or pair at least, so the corpus is read three
times: for words, for the hashes of pairs of frequent words, and for phrases all of whose
pairs are frequent.  Shards know what is frequent by a Bloom filter of fixed size, which
lets a few rare ones through and leaves none of the frequent ones out; the merged
counts of words and phrases decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import memory_returned, scope, table, written
from quire.llm.tokens import Words, byte_set, strings
from quire.llm.words import mix, text_bytes

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, INSIDE = 2_000_000, 80
#: Bytes of texts in a shard's suffix array; a piece without any break is never cut.
SHARD_BYTES = 1 << 23
#: Bits of the filter that goes to every task, whatever the size of the corpus.
FILTER_BITS = 1 << 26

BREAK = byte_set((0x0A, 0x0D), *((b, b) for b in b".,;:!?"))
APART = BREAK | byte_set((0x20, 0x20), (0x09, 0x09))
COUNTS, KEYS = "lang string, phrase string, count long", "key long, count long"
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407], dtype=np.uint64)


def phrase_hash(hashes: np.ndarray, at: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """Hash of the ``n`` words that start at each of ``at``, in the language with hash ``lang``."""
    out = mix(lang + np.uint64(n))
    for k in range(n):
        out = mix(out * _PAIR[0] + hashes[at + k] * _PAIR[1])
    return out


def lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each string, taken as one word."""
    marked = pa.array(["x" + s for s in langs.to_pylist()], pa.string())
    return Words(*text_bytes(marked), np.zeros(256, dtype=bool)).hashes


class BloomFilter:
    """Three bits for each hash in words of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(mix(hashes * _PAIR[k]) % np.uint64(bits)).astype(np.int64) for k in range(3)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in self.places(hashes, 64 * len(self.words)):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return out


def bloom_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The words of a filter of the hashes ``key``; ``bits / 8`` bytes however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(BloomFilter.places(batch.column(0).to_numpy().view(np.uint64), bits))
            slot, of = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(slot), dtype=np.uint64)
            np.bitwise_or.at(value, of, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(value.view(np.int64))], ["slot", "value"])

    found = keys.select("key").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["slot"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return out


def word_keys(words: DataFrame) -> DataFrame:
    """``key``: the hashes of the rows ``lang, phrase`` of one word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = Words(*text_bytes(batch.column(1)), np.zeros(256, dtype=bool)).hashes
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(hashes, np.arange(len(hashes)), 1, lang_hashes(batch.column(0))).view(np.int64))], ["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key long")


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence of word ids in order, and the common prefix of each with the one before, both up to ``depth`` words.

    ``left[i]`` is how many words the piece of word ``i`` still has; a suffix ends with its piece.
    Ranks by the first words are doubled in length until they cover ``depth``.
    """
    n = len(ids)
    ranks = [ids.astype(np.int64) + 1]  # by 1, 2, 4 ... words; 0 is the end of a piece
    size = 1
    while size < depth:
        rank = ranks[-1]
        behind = np.zeros(n, dtype=np.int64)
        on = np.flatnonzero(left > size)
        behind[on] = rank[on + size]
        both = rank * (int(rank.max(initial=0)) + 1) + behind
        ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int64) + 1)
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    # the common prefix: by halves, longest ranks first
    one, two = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), dtype=np.int64)
    most = np.minimum(left[order], depth)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        some = np.flatnonzero(common + step <= np.minimum(most[:-1], most[1:]))
        same = some[ranks[k][one[some] + common[some]] == ranks[k][two[some] + common[some]]]
        common[same] += step
    return order, np.minimum(np.concatenate([[0], common]) if n else common, most if n else common)


def ngram_counts(ids: np.ndarray, left: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length its distinct n-grams: the length, a place where each stands, and its count."""
    order, common = suffix_array(ids, left, longest)
    for n in range(shortest, longest + 1):
        has = left[order] >= n
        # an interval of common prefixes of n words begins where a suffix shares fewer with the one before
        begins = np.flatnonzero(has & (common < n))
        total = np.concatenate([[0], np.cumsum(has)])
        ends = np.append(begins[1:], len(order))
        yield n, order[begins], total[ends] - total[begins]


def _left(breaks: np.ndarray) -> np.ndarray:
    """For each word how many words follow up to the next break, itself included; ``breaks``: a piece begins here."""
    n = len(breaks)
    begins = np.flatnonzero(breaks)
    ends = np.append(begins[1:], n)
    return np.repeat(ends, ends - begins) - np.arange(n)


def shard_counts(langs: pa.Array, texts: pa.Array, shortest: int, longest: int, known: BloomFilter | None, part: int, as_keys: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of some texts; with ``known``, only of those all of whose ``part`` words in a row it has.

    Rows of :data:`KEYS` or of :data:`COUNTS`; with words also the number of all words, as the phrase "".
    """
    raw, offsets = text_bytes(texts)
    words = Words(raw, offsets, APART)
    if not len(words):
        return
    names = langs.dictionary_encode()
    code = names.indices.to_numpy()[words.rows]
    lang = lang_hashes(names.dictionary)[code]
    stops = np.cumsum(BREAK[raw], dtype=np.int32)[words.raw_starts]
    breaks = np.ones(len(words), dtype=bool)
    breaks[1:] = (stops[1:] != stops[:-1]) | (words.rows[1:] != words.rows[:-1])
    if shortest == 1:
        total = np.bincount(code, minlength=len(names.dictionary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(some)), pa.array([""] * len(some)), pa.array(total[some])], ["lang", "phrase", "count"])
    whole = _left(breaks)
    if known is not None:
        # a part that is not frequent ends a piece: the next one begins at its second word
        at = np.flatnonzero(whole >= part)
        rare = at[~known.has(phrase_hash(words.hashes, at, part, lang[at]))]
        if part == 1:
            breaks[rare] = True
            breaks[rare[rare + 1 < len(words)] + 1] = True
        else:
            breaks[rare + 1] = True
        whole = _left(breaks)
    kept = np.flatnonzero(np.repeat((whole >= shortest)[breaks], np.diff(np.append(np.flatnonzero(breaks), len(words)))))
    if not len(kept):
        return
    ids = np.unique(phrase_hash(words.hashes, kept, 1, code[kept].astype(np.uint64)), return_inverse=True)[1]
    for n, at, count in ngram_counts(ids, whole[kept], shortest, longest):
        first = kept[at]
        for a in range(0, len(first), 1 << 18):
            begin = first[a : a + (1 << 18)]
            many = pa.array(count[a : a + len(begin)])
            if as_keys:
                yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(words.hashes, begin, n, lang[begin]).view(np.int64)), many], ["key", "count"])
                continue
            last = begin + n - 1
            phrase = strings(words.letters, words.starts[begin], words.starts[last] + words.lengths[last] - words.starts[begin])
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[begin])), phrase, many], ["lang", "phrase", "count"])


def pieces_of(text: bytes, size: int) -> Iterator[bytes]:
    """A long text cut behind breaks, so that a part has about ``size`` bytes."""
    a = 0
    marks = np.flatnonzero(BREAK[np.frombuffer(text, np.uint8)]) + 1
    while len(text) - a > size:
        k = int(np.searchsorted(marks, a + size, side="right"))
        stop = int(marks[k - 1]) if k and marks[k - 1] > a else int(marks[k]) if k < len(marks) else len(text)
        yield text[a:stop]
        a = stop
    yield text[a:]


def counts(texts: DataFrame, shortest: int, longest: int, least: int, known: np.ndarray | None = None, part: int = 1, as_keys: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, phrase, f`` of all phrases of ``texts`` (``lang``, ``text``) that stand there ``least`` times, and of "" (all words).

    With ``as_keys`` ``key, f``.  Shuffled are the counts of each shard.
    """
    held = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[pa.Array, pa.Array]] = []
        size = 0
        filter_ = None if held is None else BloomFilter(held.value)

        def shard() -> Iterator[pa.RecordBatch]:
            langs, rows = (pa.chunked_array(c, pa.string()).combine_chunks() for c in zip(*some))
            yield from shard_counts(langs, rows, shortest, longest, filter_, part, as_keys)
            memory_returned()

        for batch in batches:
            begin, ends = 0, np.cumsum(np.diff(text_bytes(batch.column(1))[1]))
            while begin < batch.num_rows:
                before = int(ends[begin - 1]) if begin else 0
                stop = int(np.searchsorted(ends, before + shard_bytes - size, side="right"))
                if stop > begin:
                    taken = batch.slice(begin, stop - begin)
                    some.append((taken.column(0), taken.column(1)))
                    size += int(ends[stop - 1]) - before
                    begin = stop
                elif some:
                    yield from shard()
                    some, size = [], 0
                else:  # one text with more than a shard's bytes
                    for cut in pieces_of(batch.column(1)[begin].as_py().encode(), shard_bytes):
                        some = [(batch.column(0).slice(begin, 1), pa.array([cut.decode()], pa.string()))]
                        yield from shard()
                    some, begin = [], begin + 1
        if some:
            yield from shard()

    if as_keys:
        return texts.mapInArrow(run, KEYS).groupBy("key").agg(F.sum("count").alias("f")).filter(F.col("f") >= least)
    found = texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("count").alias("f"))
    return found.filter((F.col("f") >= least) | (F.col("phrase") == ""))


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, scale: int = SCALE, inside: int = INSIDE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of two to four words of each language.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty); other columns are ignored;
    repeated rows count as often as they stand there; no words, no rows.  ``a`` is how often the
    phrase stands inside pieces, ``l`` and ``r`` how often the parts of its lowest-scoring cut do,
    ``score`` is ``floor(scale * a / (l + r))`` there.  A phrase inside a longer one that
    stands ``inside`` per cent as often is left out.  Order: score, ``a``, both falling, phrase by bytes.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with scope() as keep:
        words = written(counts(texts, 1, 1, least, shard_bytes=shard_bytes), "words")
        pairs = written(counts(texts, 2, 2, least, bloom_filter(word_keys(words.filter("phrase <> ''"))), 1, True, shard_bytes), "pairs")
        longer = written(counts(texts, 2, LONGEST, least, bloom_filter(pairs), 2, False, shard_bytes), "longer")
        return keep(written(ranked(words.unionByName(longer), top, scale, inside), "phrases"))


def ranked(found: DataFrame, top: int, scale: int, inside: int) -> DataFrame:
    """The result of :func:`phrases` from the frequent n-grams ``lang, phrase, f`` of all lengths, and "" (all words)."""
    found = found.withColumn("n", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
    total, known = found.filter("n = 0").select("lang", F.col("f").alias("all")), found.filter("n > 0")
    candidates = known.filter("n > 1")

    def part(first: F.Column, size: F.Column) -> F.Column:
        return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")

    # parts that stand inside longer phrases: the most frequent one decides
    parts = candidates.filter("n > 2").select("lang", "n", "f", "phrase", F.explode(F.expr("sequence(2, n - 1)")).alias("size"))
    parts = parts.select("lang", "f", "phrase", "size", F.explode(F.expr("sequence(1, n - size + 1)")).alias("first"))
    parts = parts.select("lang", part(F.col("first"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = candidates.join(parts, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    own = own.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * inside))

    cuts = own.select("lang", "phrase", "n", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("n") - F.col("k")))
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"(cast(a AS decimal(28,0)) * {scale}) div (cast(l AS decimal(28,0)) + cast(r AS decimal(28,0)))"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")


def op13_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the first 2000 phrases of each language of ``documents``."""
    return phrases(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


OP13_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
inside AS (SELECT DISTINCT lang, phrase FROM (SELECT s.lang, s.phrase, s.a, b.f FROM (SELECT lang, f, array_to_string(ws[i : i + k - 1], ' ') AS part FROM (SELECT lang, a AS f, m, ws, k, unnest(range(1, m - k + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < m)) b JOIN c s ON s.lang = b.lang AND s.phrase = b.part) WHERE 100 * f >= 80 * a),
cut AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1 : k], ' ') AS lp, array_to_string(ws[k + 1 : m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c ANTI JOIN inside USING (lang, phrase)) c),
s AS (SELECT cut.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low JOIN n USING (lang) QUALIFY rank <= 2000"""
