"""Queries over tables of odd rows, made here, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import rules as R
from quire.plans import registry

PAGES = [
    "Tom &amp; Jerry", "cut off &amp", "all &amp;&amp;amp; of&am", "say &quot;x&quot; &quot", "&lt;b&gt; &#39;&#x27;&nbsp;&copy", " two\nlines\n", "\ttab\t", "　wide　", "\u00a0 x\u2003\u00a0", "", " ", "&", "&&amp", "R&D; AT&T",
]


def by_sql(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    return [c[0] for c in want.description], sorted(want.fetchall(), key=repr)


def by_spark(spark, name, folder, columns):
    return sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(folder)).collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    def store(table, rows, schema):
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return path

    return store


def test_titles_keep_the_entities_that_sql_keeps(spark, tmp_path, stored):
    pages = [(k, "https://a.example/", f'<html><head><title>{t}</title></head><body class="x&amp;y"><p>&amp;</p></body></html>') for k, t in enumerate(PAGES)]
    path = stored("pages", [*pages, (100, "u", None), (101, "u", "<p>no title</p>"), (102, "u", "")], "page_id long, url string, html string")
    columns, want = by_sql("selector_titles", pages=path)
    assert by_spark(spark, "selector_titles", tmp_path, columns) == want
    assert dict(want)[1] == "cut off &amp" and dict(want)[3] == "say &quot;x&quot; &quot"


def test_written_values(spark):
    row = spark.createDataFrame([('<p title=" a&amp;b ">x &lt; y &amp</p><script>1 && 2</script>',)], "h string").select(R.written_value(F.col("h"), "p").alias("p"), R.written_value(F.col("h"), "p::attr(title)").alias("a"), R.written_value(F.col("h"), "script").alias("s"), R.selector_value(F.col("h"), "p").alias("d")).first()
    assert tuple(row) == ("x &lt; y &amp", " a&amp;b ", "1 && 2", "x < y &")


def documents(texts):
    return [(k, t, "en", "src1", len(t or "")) for k, t in texts]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_headings_behind_empty_texts_and_others(spark, tmp_path, stored):
    texts = [None, "", "x", "\n", "［＃中見出し］甲［＃中見出し終わり］\n乙", "［＃大見出し］", "a［＃小見出し］b［＃", "見出し終わり］", "😀é\u0301", "\r\n\u2028", "long " * 9000]
    columns, want = by_sql("heading_sections", documents=stored("documents", documents(enumerate(texts)), DOCUMENTS))
    assert by_spark(spark, "heading_sections", tmp_path, columns) == want
    assert (0, None, "題", 2) in want and (1, 0, "題", 2) in want


TITLES = [None, "", " ", "---", " | ", "　", "-　-", "-　-　-", "\u00a0x\u00a0", "\u00a0", "a - - b", "/a/", "a　 \tb", "\ufeff", "@", "a@b.example", "x (y) z", "=", "~a:", "long " * 3000]


def test_entries_without_a_title_are_left_out_where_sql_leaves_them_out(spark, tmp_path, stored):
    texts = [(8 * n + k, t if t is None else t + end) for n, t in enumerate(TITLES) for k, end in enumerate(["", "\nx"] * 4)]
    columns, want = by_sql("normalised_entries", documents=stored("documents", documents(texts), DOCUMENTS))
    assert by_spark(spark, "normalised_entries", tmp_path, columns) == want
    assert len(want) < len(texts) and (8, "", "author8", "") in want
