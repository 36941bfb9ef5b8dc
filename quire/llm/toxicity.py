"""Operator 3: toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned: terms that stand far more often in documents labelled
toxic than in others, with their log-odds as weights.  Documents are counted, exact
copies as one; every term that meets the odds is taken.  Every distinct word of a
text becomes a Levenshtein automaton (one bit per state, a mask per letter) that
is run along the trie; where both accept, the word is a term or a misspelling of
one.  Words that clean documents use are exceptions and only count as themselves.

Each hit is then looked at in a window of words around it: inside quotation marks
or near a word that stands by hits in clean documents it is quoted, near a word that stands by
hits in toxic ones it is aimed at someone; both kinds of words are learned.  A logistic
regression over the summed weights gives the score.

Lexicon, cues and regression are fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS`` of each class), the lexicon on three quarters of it, the others on the
rest; scoring reads every text as a whole and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import memory_returned, table, texts_of, written

#: Labelled rows of each class that the model may be fitted on.
SAMPLE_ROWS = 8000
#: A term stands in so many toxic documents of the sample at least, with such log-odds.
LEAST_DOCS, LEAST_ODDS = 3, 2.0
THRESHOLD = 0.3
#: Words on either side of a hit that set its context.
WINDOW = 6

#: A cue stands near hits in so many documents of one class at least, with such log-odds.
CUE_DOCS, CUE_ODDS = 5, 1.0

#: Letters, with digits and marks that stand for letters inside.
WORD = re.compile(r"[^\W\d_]+(?:[\d*@$!]+[^\W\d_]+)*")
QUOTES = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‘[^’\n]+’")

FEATURES = 7
#: Shorter terms count as they are only.
LEAST_LETTERS = 5


def tolerance(length: int) -> int:
    """Edits that a word of this length may be from a term of ``LEAST_LETTERS`` or more."""
    return 0 if length < LEAST_LETTERS - 1 else 1


def shorter(word: str) -> list[str]:
    """The word without each of its letters."""
    return [word[:k] + word[k + 1 :] for k in range(len(word))]


class Trie:
    """Terms by letters; a node is a dictionary, a term's number stands under ''.

    A word one edit from a term equals it or shares a form of it that lacks one letter
    (:meth:`may`), so the automaton runs for few words.
    """

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.numbers = {t: n for n, t in enumerate(terms)}
        self.lengths = [len(t) for t in terms]
        self.longest = max(self.lengths, default=0)
        self.forms = {f for t in terms for f in (t, *shorter(t))}
        self.ends = {t[k:] for t in terms for k in range(len(t) + 1)}
        for n, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = n

    def may(self, word: str) -> bool:
        """False only for words that are more than one edit, or one swap, from every term."""
        return word in self.forms or not self.forms.isdisjoint(shorter(word))

    def swapped(self, word: str) -> tuple[int, int] | None:
        """The first term that two neighbouring letters in each other's place give, as one edit."""
        found = [self.numbers[w] for k in range(len(word) - 1) if (w := word[:k] + word[k + 1] + word[k] + word[k + 2 :]) in self.numbers]
        return (1, min(found)) if found else None

    def nearest(self, word: str, edits: int) -> tuple[int, int] | None:
        """As :meth:`within`, a swap counting as one edit; words too long for any term are left before any form is made."""
        if len(word) > self.longest + edits:
            return None
        if edits == 0:
            return self.within(word, 0)
        if edits < 2 and not self.may(word):
            return None
        found = self.within(word, edits) or self.swapped(word)
        return found if found and (found[0] == 0 or self.lengths[found[1]] >= LEAST_LETTERS) else None

    def within(self, word: str, edits: int) -> tuple[int, int] | None:
        """The nearest term as (edits, number), the smaller number first; None if none is near.

        The word's automaton has a state for each number of letters read and of edits
        made; states of equal edits are the bits of one integer.  With all edits made,
        the rest of the word must end a term, or the state is dropped.
        """
        if edits == 0:
            n = self.numbers.get(word)
            return None if n is None else (0, n)
        end = 1 << len(word)
        masks: dict[str, int] = {}
        open_ends = end
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | (1 << i)
            if word[i:] in self.ends:
                open_ends |= 1 << i
        full = (end << 1) - 1

        def read(states: tuple[int, ...], mask: int) -> tuple[int, ...]:
            last = states[0]
            now = (last & mask) << 1
            after = [now]
            for here in states[1:]:
                now = (((here & mask) | last | now) << 1 | last) & full
                last = here
                after.append(now)
            after[-1] &= open_ends
            return tuple(after)

        best: tuple[int, int] | None = None
        stack = [(self.root, tuple((1 << (e + 1)) - 1 & full for e in range(edits + 1)))]
        while stack:
            node, states = stack.pop()
            if "" in node:
                e = next((e for e, s in enumerate(states) if s & end), None)
                if e is not None and (best is None or (e, node[""]) < best):
                    best = (e, node[""])
            other = read(states, 0)
            # where a letter that the word lacks leaves no state, only its own letters matter
            for c in node if any(other) else masks:
                if c and c in node:
                    after = read(states, masks[c]) if c in masks else other
                    if any(after):
                        stack.append((node[c], after))
        return best


@dataclass
class Model:
    """Terms with weights, exceptions, and the regression over the features."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    exceptions: frozenset[str] = frozenset()
    beta: list[float] = field(default_factory=lambda: [-3.0] + [0.0] * (FEATURES - 1))
    quoting: frozenset[str] = frozenset()
    aiming: frozenset[str] = frozenset()


class Scorer:
    """A worker's model with what it has found out about words."""

    def __init__(self, model: Model):
        self.model, self.trie, self.known = model, Trie(model.terms), {}

    def hits(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The words that are terms or near one, with the edits and the term."""
        if len(self.known) > 400_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            edits = 0 if w in self.model.exceptions else tolerance(len(w))
            self.known[w] = self.trie.nearest(w, edits)
        get = self.known.__getitem__
        return {w: h for w in set(words) if (h := get(w))}

    def features(self, text: str) -> list[float]:
        """1; logs of summed weights of exact and of misspelled terms, of the largest, of quoted and of addressed ones, and of the share of words."""
        low = text.lower()
        words = WORD.findall(low)
        found = self.hits(words)
        if not found:
            return [1.0] + [0.0] * (FEATURES - 1)
        spans = [m.span() for m in QUOTES.finditer(low)]
        exact = fuzzy = most = quoted = aimed = 0.0
        opened = 0
        for k, m in enumerate(WORD.finditer(low)):
            h = found.get(m.group())
            if not h:
                continue
            weight = self.model.weights[h[1]] * 0.6 ** h[0]
            near = words[max(0, k - WINDOW) : k + WINDOW + 1]
            while opened < len(spans) and spans[opened][1] <= m.start():
                opened += 1
            inside = opened < len(spans) and spans[opened][0] <= m.start()
            if inside or not self.model.quoting.isdisjoint(near):
                quoted += weight
                weight *= 0.3
            if not self.model.aiming.isdisjoint(near):
                aimed += weight
            if h[0]:
                fuzzy += weight
            else:
                exact += weight
            most = max(most, weight)
        share = 100 * (exact + fuzzy) / len(words)
        return [1.0, *(float(np.log1p(x)) for x in (exact, fuzzy, most, quoted, aimed, share))]

    def neighbours(self, text: str) -> set[str]:
        """The words in the windows of all hits."""
        words = WORD.findall(text.lower())
        found = self.hits(words)
        return {w for k, word in enumerate(words) if word in found for w in words[max(0, k - WINDOW) : k + WINDOW + 1] if w not in found}

    def score(self, text: str) -> float:
        z = sum(b * x for b, x in zip(self.model.beta, self.features(text)))
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    """Coefficients of a ridge logistic regression by Newton's method; the first is not penalised."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents outside the held-out fold.

    ``labels``: ``doc_id, toxic``; null labels and ids do not count, of several labels
    of one id the largest does.  Of each class the ``rows`` ids with the smallest
    hashes are used: three quarters for the lexicon, the others for the regression,
    whose intercept is set right for the classes' share of all labels.
    Without labels of both classes every text gets the same low score.
    """
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    of = of.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    all_of = {r["toxic"]: r["count"] for r in of.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = of.filter("toxic = 1").orderBy(*order).limit(rows).unionByName(of.filter("toxic = 0").orderBy(*order).limit(rows))
    # at most 2 * rows pairs of two numbers
    sample = texts_of(docs).join(F.broadcast(some), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)))
    sample = written(sample, "labelled")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(set(WORD.findall(text.lower())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["term", "toxic"])

    learn = written(sample.filter("fold <> 0").select("text", "toxic").distinct(), "learned")
    totals = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model()
    counts = learn.mapInArrow(distinct_words, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1))
    counts = written(counts.withColumn("odds", odds), "terms")
    strong = counts.filter((F.col("bad") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    # words of the bounded sample
    chosen = strong.orderBy(F.col("bad").desc(), F.col("odds").desc(), "term").collect()
    model = Model([r["term"] for r in chosen], [min(6.0, r["odds"]) for r in chosen])

    def misleading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if trie.nearest(w, tolerance(len(w)))], pa.string())], ["term"])

    clean = counts.filter((F.col("all") - F.col("bad") >= 2) & (F.col("odds") < 1))
    near = clean.select("term").mapInArrow(misleading, "term string").collect()  # words of the bounded sample
    model.exceptions = frozenset(r["term"] for r in near)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # the empty word counts the documents with hits
                found = scorer.neighbours(text)
                found = [*found, ""] if found else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["word", "toxic"])

    by_word = learn.mapInArrow(neighbours, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).filter(F.col("all") >= CUE_DOCS)
    seen = {r["word"]: (r["bad"], r["all"] - r["bad"]) for r in by_word.collect()}
    hit_bad, hit_good = seen.pop("", (0, 0))
    lean = {w: np.log((b + 0.5) / (hit_bad + 1)) - np.log((g + 0.5) / (hit_good + 1)) for w, (b, g) in seen.items()}
    model.quoting = frozenset(w for w, x in lean.items() if x <= -CUE_ODDS and seen[w][1] >= CUE_DOCS)
    model.aiming = frozenset(w for w, x in lean.items() if x >= CUE_ODDS and seen[w][0] >= CUE_DOCS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    fitted = sample.filter("fold = 0").select("text", "toxic").mapInArrow(rows_of, "x array<double>, toxic int").collect()
    y = np.array([float(r["toxic"]) for r in fitted])
    if len(y) and 0 < y.sum() < len(y):
        model.beta = logistic(np.array([r["x"] for r in fitted]), y)
        # the larger class is thinned more
        thinned = {c: all_of[c] / min(all_of[c], rows) for c in (0, 1)}
        model.beta[0] += float(np.log(thinned[1] / thinned[0]))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text scores as one without hits; a null id is never held out;
    repeated rows are scored alike; an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])
        del scorer
        memory_returned()

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores below ``threshold``; null texts stay."""
    names = docs.columns
    schema = docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep))
        del scorer
        memory_returned()

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, labels from outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
