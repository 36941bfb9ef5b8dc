import json

from pyspark.sql import functions as F

from quire.functions import payload

BOOK = {"book_id": "7", "name": "The \"book\"\nof 日本", "first_chapter_id": "c1", "more": [1, {"x": None}]}


def page(*lines, broken=False):
    text = "".join(f"{k}:{v if isinstance(v, str) else json.dumps(v, ensure_ascii=k % 2 == 0)}\n" for k, v in enumerate(lines))
    return f"<script>self.__next_f.push([1,{json.dumps(text)[:-3] if broken else json.dumps(text)}])</script>"


def nested(value, depth, kind="list"):
    for k in range(depth):
        value = [0, value] if kind == "list" or k % 2 else {"a": "b", "k": value}
    return value


def find(html, wanted="7", **more):
    return next((o for v in payload.values_of(html) if (o := payload.first_object(v, "book_id", wanted, ("name", "first_chapter_id"), **more))), None)


def test_depth_and_kinds():
    for kind in ("list", "dict"):
        assert find(page(nested(BOOK, 15, kind))) == BOOK
        assert find(page(nested(BOOK, 16, kind))) is None
        assert find(page(nested(BOOK, 3, kind)), depth=2) is None


def test_order_and_conditions():
    first, unnamed, other = {**BOOK, "name": "first"}, {**BOOK, "name": ""}, {**BOOK, "book_id": 7}
    assert find(page([unnamed, other, {"x": [first]}, BOOK])) == first
    assert find(page({**BOOK, "inner": first}))["name"] == BOOK["name"]  # from the outside in
    assert find(page(other, unnamed)) is None


def test_broken_pieces_and_lines():
    assert find(page(BOOK, broken=True) + page(BOOK)) == BOOK
    assert find(page("{not json", "text", "", "I[1]", BOOK)) == BOOK
    assert find(page("[" * 5000 + "]" * 5000, BOOK)) == BOOK
    assert find("no payload") is None


def test_column(spark):
    rows = [(page(BOOK), "7"), (page(BOOK), "8"), (None, "7"), (page(BOOK), None), ("", "7")]
    got = spark.createDataFrame(rows, "html string, id string").select(payload.found_object(F.col("html"), F.col("id"), "book_id", ["name"]).alias("o")).collect()
    assert [r.o and json.loads(r.o) for r in got] == [BOOK, None, None, None, None]
