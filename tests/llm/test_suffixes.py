import hashlib
import random

import numpy as np
import pytest

from quire.llm import suffixes
from quire.llm.induced import induced_order
from tests.llm.cases import clashing, docs, empty_docs, odd_docs


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_induced_order(limit):
    r = random.Random(1)
    for trial in range(300):
        n = r.choice([0, 1, 2, 5, 30, 200])
        letters = r.choice([[2], [2, 3], list(range(1, 8)), list(range(1, 258))])
        text = [r.choice(letters) for _ in range(n)]
        if n > 20 and r.random() < 0.5:
            text[10:10] = text[: n // 2]
        text = np.array([*text, 0], dtype=np.uint16)
        for depth in (3, 10, 500):
            order = induced_order(text, depth, limit).tolist()
            assert sorted(order) == list(range(len(text)))
            cut = [tuple(text[i : i + depth].tolist()) for i in order]
            assert cut == sorted(cut), (trial, depth)


def brute(rows, size):
    first = {}
    for d, t in rows:
        if d is None:
            continue
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for k in range(len(b) - size + 1):
                if first[b[k : k + size]] < d:
                    gone[k : k + size] = b"\x01" * size
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    r = random.Random(seed)
    letters = "abcdefgh éß你"
    passages = ["".join(r.choice(letters) for _ in range(r.choice([20, 49, 50, 51, 80, 300]))) for _ in range(12)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            parts.append(r.choice(passages) if kind < 0.4 else "ab" * r.randint(1, 60) if kind < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(0, 60))))
        out.append("".join(parts))
        if out and r.random() < 0.15:
            out.append(r.choice(out))
    return out


def test_against_brute_force(spark):
    table = clashing(docs(spark, planted(3)), "segment", "n_bytes", "spans").unionByName(odd_docs(spark), allowMissingColumns=True)
    got = suffixes.deduplicated(table).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1]) for r in table.select("doc_id", "text").collect()], 50)


def test_empty(spark):
    assert suffixes.deduplicated(empty_docs(spark)).count() == 0
