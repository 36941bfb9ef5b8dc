import random

import numpy as np

from quire.llm import chaining
from tests.llm.cases import clashing, docs, empty_docs, odd_docs


def slow_chain_score(blocks, cost):
    best = []
    for x, y, n in blocks:
        before = [s - cost * (x - a - m + y - b - m) for (a, b, m), s in zip(blocks, best) if a + m <= x and b + m <= y]
        best.append(n + max([0.0, *before]))
    return max(best)


def test_chains_are_best():
    r = random.Random(1)
    for _ in range(300):
        blocks = np.array(sorted((r.randint(0, 60), r.randint(0, 60), r.randint(1, 9)) for _ in range(r.randint(1, 14))))
        found = chaining.chains(blocks, 0)
        assert sorted(i for c in found for i in c) == list(range(len(blocks)))
        first = [blocks[i].tolist() for i in found[0]]
        score = sum(n for _, _, n in first) - chaining.GAP_COST * sum(x2 - x1 - n1 + y2 - y1 - n1 for (x1, y1, n1), (x2, y2, _) in zip(first, first[1:]))
        if len(found) == 1 or len(first) > 1:
            assert abs(score - slow_chain_score(blocks.tolist(), chaining.GAP_COST)) < 1e-9
        for a, b in zip(first, first[1:]):
            assert a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1]


def test_minima_cover_every_window():
    r = np.random.default_rng(2)
    for _ in range(100):
        row = np.sort(r.integers(0, 4, r.integers(0, 60)))
        value = r.integers(0, 20, len(row)).astype(np.uint64)
        got = set(chaining.minima(value, row, 5).tolist())
        want = set()
        for k in set(row.tolist()):
            at = np.flatnonzero(row == k)
            for a in range(max(1, len(at) - 4)):
                w = at[a : a + 5]
                want.add(int(w[np.argmin(value[w])]))
        assert got == want


def test_common_words():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([2, 9, 3, 5])
    assert chaining.common_words(a, b) == 3
    assert chaining.extension(np.array([1, 2, 3, 9, 5, 6, 7]), np.array([1, 2, 3, 4, 5, 6, 7])) == (7, 6, True)


def planted(seed):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(10**7))
    passages = [[word() for _ in range(r.randint(52, 120))] for _ in range(8)]
    texts, holds = [], []
    for _ in range(150):
        own = [word() for _ in range(r.randint(0, 150))]
        which = r.sample(range(8), r.choice([0, 0, 1, 1, 2]))
        for p in which:
            body = list(passages[p])
            for _ in range(r.randint(0, len(body) // 20)):
                body[r.randrange(len(body))] = word()
            if r.random() < 0.4:
                del body[len(body) // 2]
            at = r.randrange(len(own) + 1)
            own[at:at] = body
        texts.append(" ".join(own))
        holds.append(set(which))
    return texts, holds


def test_planted_passages(spark):
    texts, holds = planted(5)
    table = clashing(docs(spark, texts), "seed", "start", "source_id")
    got = chaining.passages(table).collect()
    seen = {}
    for d, h in enumerate(holds):
        for p in h:
            seen.setdefault(p, []).append(d)
    again = {d for ds in seen.values() for d in ds[1:]}
    assert {r.doc_id for r in got} == again
    assert all(r.source_id < r.doc_id and holds[r.doc_id] & holds[r.source_id] for r in got)
    cleaned = chaining.remove_passages(table)
    assert cleaned.schema == table.schema
    for r in cleaned.collect():
        assert r.text == texts[r.doc_id] if r.doc_id not in again else len(r.text) < len(texts[r.doc_id]) and r.n_chars == len(r.text)
    # first documents keep their passage, so nothing is left to find but what was cut into pieces
    assert chaining.passages(cleaned).count() <= 0.05 * len(got)


def test_without():
    assert chaining.without("a b  c\nd e", [(1, 2)]) == "a\nd e"
    assert chaining.without("a b c", [(0, 3)]) == ""
    assert chaining.without("a b c d", [(0, 2), (1, 2)]) == " d"


def test_odd_rows(spark):
    table = odd_docs(spark)
    assert chaining.passages(empty_docs(spark)).count() == 0
    chaining.passages(table).collect()
    kept = chaining.remove_passages(table)
    assert kept.filter("text is null").count() == table.filter("text is null").count()


def whole_again(spark, pieces, length):
    """Share of a passage of ``length`` words found in the last document; earlier ones hold its pieces, one the whole."""
    r = random.Random(9)
    word = lambda: "w" + str(r.randrange(10**7))
    passage = [word() for _ in range(length)]
    own = lambda: [word() for _ in range(30)]
    texts = [[*own(), *passage[a:b], *own()] for a, b in pieces]
    texts += [[*own(), *passage, *own()] for _ in range(2)]
    table = docs(spark, [" ".join(t) for t in texts])
    got = chaining.passages(table).filter(f"doc_id = {len(texts) - 1}").collect()
    return len({k for p in got for k in range(p.start, p.start + p.length)} & set(range(30, 30 + length))) / length


def test_passage_pieced_together_from_earlier_documents(spark):
    assert whole_again(spark, [(0, 30), (30, 60)], 60) == 1


def test_passage_of_overlapping_pieces(spark):
    assert whole_again(spark, [(a, a + 35) for a in range(0, 1165, 15)], 1200) >= 0.98


def test_a_copy_whose_pieces_stand_in_earlier_documents(spark):
    r = random.Random(21)
    p, q = ([f"w{r.randrange(10**6)}" for _ in range(35)] for _ in range(2))
    table = docs(spark, [" ".join(p), " ".join(q), " ".join(p + q), " ".join(p + q)], first=1)
    found = {(x.doc_id, x.source_id) for x in chaining.passages(table).collect()}
    assert (4, 3) in found


def test_columns_named_like_those_within(spark):
    r = random.Random(22)
    p = " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
    table = clashing(docs(spark, [p + " end", "start " + p]), "_spans", "_doc", "_hash", "spans", "row", "text_hash")
    got = chaining.remove_passages(table)
    assert got.columns == table.columns
    assert {x.doc_id: x.text for x in got.collect()} == {0: p + " end", 1: "start"}


def test_very_many_cuts():
    n = 1200
    a, b = np.arange(20 * n), np.arange(20 * n) + 10**6
    xs = list(range(0, 20 * n, 20))
    for x in xs:
        b[x : x + 5] = a[x : x + 5]
    assert chaining.accepted(xs, xs, [5] * n, a, b, 40, 0.8)[0] == []


def test_a_passage_that_goes_on_far_beyond_its_chain(spark):
    r = random.Random(23)
    p = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    # every fifth word changed: most of the text has no seed of its own
    other = [w if k < 100 or k % 12 else f"x{k}" for k, w in enumerate(p)]
    found = chaining.passages(docs(spark, [" ".join(p), " ".join(other)])).collect()
    assert found and max(x.length for x in found) > 2900
