import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import katz
from tests.llm.cases import clashing, docs, empty_docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute(rows):
    one, two, followers = Counter(), Counter(), defaultdict(set)
    for d, t in rows:
        if not held(d):
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w], w))
    for a, b in two:
        followers[a].add(b)
    contexts = Counter()
    for (a, _), n in two.items():
        contexts[a] += n
    total, types = sum(one.values()), len(one)
    of = lambda counts: [0] + [sum(1 for n in counts.values() if n == r) for r in range(1, katz.CUTOFF + 2)]
    d1, d2 = katz.discounts(of(one)), katz.discounts(of(two))
    disc = lambda d, c: (d[c] if c <= katz.CUTOFF else 1.0) * c
    left = total - sum(disc(d1, c) for c in one.values())
    over, unknown = (total, left / total) if left > 0 else (total + 1, 1 / (total + 1))
    p1 = lambda w: disc(d1, one[w]) / over if one[w] else unknown

    def p2(a, w):
        if not contexts[a]:
            return p1(w)
        taken = contexts[a] - sum(disc(d2, two[a, x]) for x in followers[a])
        bottom = contexts[a] if taken > 1e-9 else contexts[a] + 1
        if two[a, w]:
            return disc(d2, two[a, w]) / bottom
        return (taken if taken > 1e-9 else 1) / bottom / (1 - sum(p1(x) for x in followers[a])) * p1(w)

    out = {}
    for k, (d, t) in enumerate(rows):
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w)
        out[k] = (d, held(d), len(w), sum(one[x] > 0 for x in w), total, base, sum(math.log10(p2(a, x)) for a, x in zip(["<s>", *w], w)))
    for a in [*list(contexts)[:40], "never seen"]:
        assert abs(sum(p2(a, x) for x in one) + p2(a, "an unknown word") - 1) < 1e-9
    return list(out.values())


def zipf_docs(spark, n=120):
    r = random.Random(6)
    texts = []
    for _ in range(n):
        out = []
        while len(out) < r.randint(3, 80):
            out.append(f"w{min(int(r.paretovariate(0.6)), 5000)}")
            if r.random() < 0.2:
                out += ["Of", "The"]
        texts.append(" ".join(out))
    return docs(spark, [*texts, *texts[:4]])


@pytest.mark.parametrize(("hot", "bucket"), [(1 / 50, 300), (1 / 1000, 1 << 22)])
def test_against_brute_force(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "CHUNK", 1000)
    table = zipf_docs(spark).unionByName(odd_docs(spark))
    got = katz.katz_scores(clashing(table, "score", "chunk", "held"), bucket=bucket).collect()
    want = brute([(r[0], r[1]) for r in table.select("doc_id", "text").collect()])
    key = lambda r: (str(r[0]), r[2], r[3], round(r[6], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_no_training_rows_and_empty(spark):
    only = next(d for d in range(100) if held(d))
    got = katz.katz_scores(docs(spark, ["some words here"], first=only)).collect()
    assert [tuple(r) for r in got] == [(only, True, 4, 0, 0, 0.0, 0.0)]
    assert katz.katz_scores(empty_docs(spark)).count() == 0


def test_better_than_base_on_held_out(spark, sf):
    got = katz.katz_scores(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def brute_of_order(rows, order):
    """Text by text: document id, tokens and log10 probability by recursion over contexts of up to ``order - 1`` tokens."""
    counts = [Counter() for _ in range(order + 1)]
    for d, t in rows:
        if not held(d):
            w = [*["<s>"] * (order - 1), *tokens(t)]
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    counts[n][tuple(w[i - n + 1 : i + 1])] += 1
    d = [katz.discounts([0] + [sum(1 for c in of.values() if c == r) for r in range(1, katz.CUTOFF + 2)]) for of in counts]
    disc = lambda n, c: (d[n][c] if c <= katz.CUTOFF else 1.0) * c
    contexts, followers = Counter(), defaultdict(set)
    for n in range(1, order + 1):
        for gram, c in counts[n].items():
            contexts[gram[:-1]] += c
            followers[gram[:-1]].add(gram[-1])
    weights = {}

    def p(context, w):
        n = len(context) + 1
        seen = contexts[context]
        if n > 1 and not seen:
            return p(context[1:], w)
        if context not in weights:
            taken = seen - sum(disc(n, counts[n][(*context, x)]) for x in followers[context])
            whole, over = taken <= 1e-9, seen + (taken <= 1e-9)
            weights[context] = over, (1 if whole else taken) / over / (1 - sum(p(context[1:], x) for x in followers[context]) if n > 1 else 1)
        over, weight = weights[context]
        c = counts[n][(*context, w)]
        return disc(n, c) / over if c else weight * (p(context[1:], w) if n > 1 else 1)

    words = [x for (x,) in counts[1]]
    for context in [g for g in list(counts[order - 1])[:40] if g[-1] != "</s>"]:
        assert abs(sum(p(context, x) for x in words) + p(context, "an unknown word") - 1) < 1e-9
    out = []
    for i, t in rows:
        w = [*["<s>"] * (order - 1), *tokens(t)]
        out.append((i, len(w) - order + 1, sum(math.log10(p(tuple(w[k - order + 1 : k]), w[k])) for k in range(order - 1, len(w)))))
    return out


@pytest.mark.parametrize(("order", "hot", "bucket", "rounds"), [(3, 1 / 50, 300, 3), (3, 1 / 1000, 1 << 22, 1), (4, 1 / 200, 1000, 2)])
def test_higher_orders_against_brute_force(spark, monkeypatch, order, hot, bucket, rounds):
    monkeypatch.setattr(katz, "HOT", hot)
    table = zipf_docs(spark).unionByName(odd_docs(spark))
    got = katz.katz_scores(table, bucket=bucket, rounds=rounds, order=order).collect()
    want = brute_of_order([(r[0], r[1]) for r in table.select("doc_id", "text").collect()], order)
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9)


def test_query_sees_contexts_of_two_words(spark, tmp_path):
    # "b" is followed by "c" after "a", by "d" after "x": one word of context cannot tell
    rows = docs(spark, ["a b c", "x b d"] * 40 + ["a b c", "a b d"])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in katz.op5_katz_backoff(spark, str(tmp_path)).collect()}
    assert score[80] > score[81] + 1
