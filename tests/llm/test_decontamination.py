import re

import pytest
from pyspark.sql import types as T

from quire.llm import wu_manber
from tests.llm.cases import ODD_TEXTS, clashing, docs, empty_docs, odd_docs

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - size + 1)):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                got = windows.get(tuple(w[i : i + m]))
                if got:
                    hit |= set(range(i, i + m))
                    found |= got
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def given(found):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.first, s.last + 1)], r.items) for r in found.collect()), key=repr)


LONG = " ".join(f"w{k}" for k in range(40))
ITEM_ROWS = [(1, LONG), (2, "Only, THREE words!"), (3, None), (4, "..."), (5, "one"), (6, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 other"), (10, "a b a b a b a b a b a b a b"), (None, "no id at all here"), (6, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 other"), (7, "über straße 你好世界 x")]
TEXTS = [*ODD_TEXTS, LONG.upper().replace(" ", " -- "), "x " + LONG[:60] + " y " + LONG + " only three; words", "only three", "ONE", "none", "a b " * 30, "word " * 5000 + LONG + " tail" * 300, "über\nstraße 你好世界\tX", "w5 w6 w7 w8 w9", "w10 w11 w12 w13 w14", LONG.replace("w20", "w99")]


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_equals_brute_force(spark, block):
    df = clashing(docs(spark, TEXTS).union(odd_docs(spark)), "spans", "items", "item_id", "key", "block", "window")
    items = clashing(spark.createDataFrame(ITEM_ROWS, ITEMS), "item", "window", "doc_id")
    got = given(wu_manber.benchmark_words(df, items, block_windows=block))
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], ITEM_ROWS)


@pytest.mark.parametrize("block", [1 << 17, 1])
def test_empty_tables(spark, block):
    none, items = spark.createDataFrame([], ITEMS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert wu_manber.benchmark_words(empty_docs(spark), items, block_windows=block).count() == 0
    df = docs(spark, ["a text of some words", None])
    assert given(wu_manber.benchmark_words(df, none, block_windows=block)) == [(0, 5, [], []), (1, 0, [], [])]


def test_search_moves_on_by_the_shift_table():
    import numpy as np
    import pyarrow as pa

    search = wu_manber.WuManber(pa.array([LONG[:100].rsplit(" ", 1)[0].split(" w10")[0]]))
    text = " ".join(f"v{k}" for k in range(64000))
    raw = np.frombuffer(text.encode(), np.uint8)
    mine = wu_manber.Words(raw, np.array([0, len(raw)]), wu_manber.APART)
    _, _, seen = search.lengths[0].candidates(mine)
    assert seen < len(mine) / 7


def test_very_long_texts_and_words(spark):
    texts = ["x" * 300_000 + " " + LONG, (LONG + " gap ") * 3000, "y" * 200_000]
    df = docs(spark, texts)
    assert given(wu_manber.benchmark_words(df, spark.createDataFrame(ITEM_ROWS, ITEMS))) == brute(list(enumerate(texts)), ITEM_ROWS)
