import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import phrases
from tests.llm.cases import SCHEMA, clashing, empty_docs, odd_docs


def grams(rows):
    """Counts of all n-grams of one to four words by language, and of all words."""
    found, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    found[lang, tuple(w[i : i + n])] += 1
    return found, total


def brute(rows, least, top):
    found, total = grams(rows)
    candidates = {k: a for k, a in found.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), f in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                part = (lang, p[i : i + size])
                if 100 * f >= 80 * candidates[part]:
                    dropped.add(part)
    by = {}
    for (lang, p), a in candidates.items():
        if (lang, p) in dropped:
            continue
        score, _, left, right = min((2000000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k, found[lang, p[:k]], found[lang, p[k:]]) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for lang, mine in by.items() for r, (s, a, p, left, right) in enumerate(sorted(mine)[:top]))


def rows_of(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


def given(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    vocabulary = ["the", "of", "New", "York", "City", "é", "über", "a", "B", "x\x1cy", "z'z"] + [f"w{k}" for k in range(30)]
    marks = [" ", "  ", "\t", " \t ", ". ", ", ", "\n", "!?", "\r\n", "\x0b"]
    rows = []
    for k in range(n):
        some = r.choice(vocabulary, 60, p=np.r_[np.full(11, 0.05), np.full(30, 0.015)])
        text = "".join(w + marks[m] for w, m in zip(some, r.choice(10, 60, p=[0.7] + [0.3 / 9] * 9)))
        rows.append((k, text + "new york city hall" * (k % 3), ["en", "EN", None, "", "de"][k % 5], "s", len(text)))
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


@pytest.mark.parametrize(("size", "top"), [(1 << 24, 2000), (300, 7)])
def test_equals_brute_force(spark, size, top):
    df = clashing(corpus(spark).union(odd_docs(spark)), "phrase", "n", "f", "rank")
    got, want = given(phrases.phrases(df, least=12, top=top, shard_bytes=size)), brute(rows_of(df), 12, top)
    assert len(want) > 20 and got == want


def test_no_words(spark):
    assert phrases.phrases(empty_docs(spark)).count() == 0
    assert phrases.phrases(spark.createDataFrame([(1, None, None, None, None), (2, " .\n", "en", "s", 3)], SCHEMA)).count() == 0


def test_long_text_is_cut_at_breaks_only(spark):
    text = "one two three four, " * 3000 + "five six " * 2000 + "y" * 50_000
    df = spark.createDataFrame([(1, text, "en", "s", len(text))], SCHEMA)
    assert given(phrases.phrases(df, shard_bytes=1000)) == brute([("en", text)], 30, 2000)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(5)
    ids, left = r.integers(0, 3, 300), phrases._left(np.r_[True, r.random(299) < 0.2])
    key = lambda i: tuple(ids[i : i + min(4, left[i])].tolist())
    order, common = phrases.suffix_array(ids, left, 4)
    assert sorted(order.tolist()) == list(range(300))
    keys = [key(i) for i in order]
    assert keys == sorted(keys)
    for a, b, c in zip(keys, keys[1:], common[1:].tolist()):
        assert c == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_sums_beyond_64_bits(spark):
    big = 10**17
    found = spark.createDataFrame([("en", "", 9 * big), ("en", "a", 3 * big), ("en", "b", 2 * big + 1), ("en", "a b", big)], "lang string, phrase string, f long")
    assert [r.score for r in phrases.ranked(found, 10, 2_000_000, 80).collect()] == [2_000_000 * big // (5 * big + 1)]
