import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import jaccard
from quire.llm.components import components
from tests.llm.cases import clashing, docs, empty_docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if a is None or b is None or not sa or min(len(sa), len(sb)) * 100 < 75 * max(len(sa), len(sb)):
                continue
            if 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = root(a), root(b)
                if x is not y and x != y:
                    parent[max(x, y)] = min(x, y)
    return Counter((d, len(s), root(d) if d is not None else None) for d, s in sets)


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        at = r.randrange(len(w) + 1)
        kind = r.random()
        if kind < 0.4 and at < len(w):
            w[at] = f"new{r.randrange(10**6)}"
        elif kind < 0.7 and at < len(w):
            del w[at]
        else:
            w.insert(at, f"new{r.randrange(10**6)}")
    return w


def planted(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.45:
            base = r.choice(out[-40:]).split(" ")
            out.append(" ".join(edited(r, base, r.randint(0, max(1, len(base) // 20)))))
        elif kind < 0.6:
            own = [r.choice(vocabulary) for _ in range(r.choice([5, 20, 40, 80]))]
            at = r.randrange(len(own))
            out.append(" ".join(own[:at] + passage + own[at:]))
        else:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 100, 300]))))
    return out


@pytest.mark.parametrize("seed, shared", [(1, 8), (2, 2)])
def test_against_brute_force(spark, seed, shared):
    table = docs(spark, planted(seed), first=100)
    got = jaccard.jaccard_components(clashing(table, "sig", "component_id", "n_shingles"), shared=shared)
    assert Counter(map(tuple, got.collect())) == brute_force([(r[0], r[1]) for r in table.select("doc_id", "text").collect()])


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """The original is not the first; copies differ from it by up to the threshold, so many of them do not link with each other."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(edited(r, base, r.randint(1, 9))) for _ in range(600)]
    texts.insert(300, " ".join(base))
    compared = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    table = docs(spark, texts)
    got = jaccard.jaccard_components(table)
    assert Counter(map(tuple, got.collect())) == brute_force(list(enumerate(texts)))
    assert sum(compared) < 8 * len(texts), compared


def test_long_text_and_its_near_copy(spark):
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    other = list(base)
    for at in r.sample(range(len(base)), 2000):
        other[at] = "changed"
    got = jaccard.jaccard_components(docs(spark, [" ".join(base), " ".join(other), "a b c"]))
    assert sorted((x[0], x[2]) for x in got.collect()) == [(0, 0), (1, 0), (2, 2)]


def test_regular_words_differ(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    got = jaccard.jaccard_components(docs(spark, [a, a.translate(str.maketrans("ab", "ba"))]))
    assert sorted((x[0], x[2]) for x in got.collect()) == [(0, 0), (1, 1)]


def test_odd_rows(spark):
    table = odd_docs(spark)
    got = jaccard.jaccard_components(table)
    assert Counter(map(tuple, got.collect())) == brute_force([(r[0], r[1]) for r in table.select("doc_id", "text").collect()])
    assert jaccard.jaccard_components(empty_docs(spark)).count() == 0


def test_every_link_shares_a_signature():
    """The guarantee itself, without Spark, over random pairs at the threshold."""
    r = np.random.default_rng(7)
    for trial in range(400):
        size = int(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 11, 15, 16, 24, 31, 32, 50, 90, 127, 200, 500]))
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        while True:  # as far apart as the threshold allows
            c = b[r.permutation(len(b))[: len(b) - 1]] if r.random() < 0.5 else np.append(b, np.uint64(r.integers(0, 2**63)))
            i = len(np.intersect1d(a, c))
            if not len(c) or 100 * i < 75 * (len(a) + len(c) - i):
                break
            b = c
        b = np.sort(b)
        value, of = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        band = max(len(a), len(b)).bit_length() - 1
        sides, spare = [{}, {}], [None, None]
        for sig, who, of_band, place, left in jaccard.signatures(value, of, 2, 75):
            for s, w, g, p, x in zip(*(c.tolist() for c in (sig, who, of_band, place, left))):
                sides[w][s] = p
                spare[w] = x if g == band and spare[w] is None else spare[w]
        both = set(sides[0]) & set(sides[1])
        assert both, (trial, size)
        share = r.choice([0.02, 0.1, 0.3])
        hot = {s for s in set(sides[0]) | set(sides[1]) if r.random() < share}
        settled = [left is None or len({p for s, p in side.items() if s in hot and p >= 0}) <= left for side, left in zip(sides, spare)]
        if all(settled):
            assert both - hot, (trial, size)


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_long_unlike_texts_are_ruled_out_by_wide_sketches(spark, monkeypatch):
    """Half of their words are equal, so they share signatures; only texts that may link are fetched."""
    r = random.Random(21)
    texts = []
    for _ in range(8):
        base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
        texts += [" ".join(base), " ".join(base[:1500] + [f"w{r.randrange(10**6)}" for _ in range(1500)])]
    texts.append(" ".join(edited(r, texts[0].split(" "), 60)))
    texts.append(" ".join(texts[1].split(" ")[:2600]))
    compared = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    got = jaccard.jaccard_components(docs(spark, texts))
    assert Counter(map(tuple, got.collect())) == brute_force(list(enumerate(texts)))
    assert 2 <= sum(compared) <= 4, compared


def test_cells_apart_folds_the_wider():
    r = np.random.default_rng(5)
    for _ in range(50):
        value = np.unique(r.integers(0, 2**63, 700).astype(np.uint64))
        other = value[r.random(len(value)) > 0.2]
        x, y = (jaccard.odd_cells(v, np.zeros(len(v), np.int64), np.array([w])) for v, w in ((value, 2048), (other, 1024)))
        got = jaccard.cells_apart(pa.array([x.tobytes(), None]), pa.array([y.tobytes(), y.tobytes()]))
        folded = [{c for c in range(1024) if np.count_nonzero(v % np.uint64(1024) == c) % 2} for v in (value, other)]
        assert got.tolist() == [len(folded[0] ^ folded[1]), 0]
        assert got[0] <= len(value) - len(other)
