"""What a bucket of n-grams takes in memory while it is answered."""

import tracemalloc

import numpy as np
import pandas as pd

from quire.llm import katz


class Taken:
    """Stands for the tables of ``answers`` and gives the function that answers a bucket."""

    def mapInArrow(self, *_):
        return self

    groupBy = mapInArrow

    def applyInPandas(self, answer, schema):
        return answer


def test_a_bucket_is_answered_in_few_bytes_an_ngram():
    r = np.random.default_rng(2)
    rows = []
    for chunk in range(16):
        contexts = katz.mix(r.integers(0, 60_000, 12_500).astype(np.uint64))
        keys = katz.gram_key(contexts, r.integers(0, 9, 12_500).astype(np.uint64))
        rows.append((0, chunk, contexts.tobytes(), keys.tobytes(), katz._packed(r.integers(0, 3, 12_500)), r.random(12_500).tobytes()))
    group = pd.DataFrame(rows, columns=["bucket", "chunk", "contexts", "keys", "times", "low"])
    answer = katz.answers(Taken(), 3, katz.Lower(100, 10, [0] * 8), np.zeros(0, np.uint64), 1000, 1, 0, 1)
    tracemalloc.start()
    try:
        out = answer(group)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(katz._unpacked([c])) for c in out["counts"]) == 16 * 12_500
    assert peak < 85 * 16 * 12_500
