import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quire.functions import diff


def slow_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnop"])
def test_longest_common_subsequence(letters):
    r = random.Random(5)
    for _ in range(250):
        a = [r.choice(letters) for _ in range(r.randrange(30))]
        b = [r.choice(letters) for _ in range(r.randrange(30))]
        found = diff.common_places(a, b)
        assert len(found) == slow_length(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        rows = diff.events(a, b)
        assert [a[x] for sign, x, _ in rows if sign != "+"] == a and [b[y] for sign, _, y in rows if sign != "-"] == b
        assert sum(sign == "=" for sign, _, _ in rows) == len(found)


def test_long_texts_in_linear_space():
    r = random.Random(1)
    a, b = ([f"line {r.randrange(400)}" for _ in range(10_000)] for _ in range(2))
    other = [f"no line {k}" for k in range(10_000)]
    tracemalloc.start()
    found = diff.common_places(a, b)
    assert not diff.common_places(a, other)
    assert len(diff.hunks("\n".join(a), "\n".join(other))) == 20_001
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert len(found) > 900 and all(a[i] == b[j] for i, j in found)


def test_hunks():
    text = "\n".join(map(str, range(20)))
    assert diff.hunks(text, text.replace("\n10\n", "\nten\n")) == ["@@ -8, +8 @@", " 7", " 8", " 9", "-10", "+ten", " 11", " 12", " 13"]
    assert diff.hunks(text, text) == [] == diff.hunks(None, "") == diff.hunks("", "\r\n\n")
    assert diff.hunks("a\r\nb\n\n", "a\nb") == []
    far = diff.hunks(text, text.replace("2\n", "x\n", 1).replace("\n15\n", "\n"))
    assert [x for x in far if x.startswith("@@")] == ["@@ -1, +1 @@", "@@ -13, +13 @@"]
    assert diff.hunks(None, "a\nb") == ["@@ -1, +1 @@", "+a", "+b"]


def test_characters_of_changed_lines():
    old, new = diff.marks("the black cat", "the blank cats")
    assert old == [{"first": 7, "last": 7, "sign": "!"}] and new == [{"first": 7, "last": 7, "sign": "!"}, {"first": 13, "last": 13, "sign": "+"}]
    assert diff.marks("abcdefghij", "klmnopqrst") == ([], [])
    # seven of ten are changed: still compared; eight: not
    assert diff.marks("abcdefghij", "abc0123456")[0] and not diff.marks("abcdefghij", "ab01234567")[0]


def test_columns(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, "z"), ("", None)], "old string, new string")
    rows = df.select(diff.line_changes(F.col("old"), F.col("new")).alias("c"), diff.line_counts(F.col("old"), F.col("new")).alias("n"), diff.line_diff(F.col("old"), F.col("new")).alias("h")).collect()
    assert [tuple(r.n) for r in rows] == [(2, 1, 2), (0, 0, 1), (0, 0, 0)]
    assert [(c.sign, c.old, c.new) for c in rows[0].c] == [("=", "a", "a"), ("!", "b", "x"), ("=", "c", "c"), ("+", None, "d")]
    assert rows[1].h == ["@@ -1, +1 @@", "+z"] and rows[2].c == []
