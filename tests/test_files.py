"""Sources, sinks, rules and conversions on small inputs of their own."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import japanese as J
from quire.functions import values as V
from quire.operators import rules as R
from quire.operators import sections as S
from quire.sources import bytes as B
from quire.sources import files


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column).first()[0]


def test_settings_file(spark, tmp_path):
    (tmp_path / "s.ini").write_text("; comment\ntop = 1\n[first]\nyes = true\nname = 'a b'\nsize = 2.5\nnone = nil\n[second]\nyes = false\n")
    got = {(r.section, r.name): r for r in files.settings(spark, str(tmp_path / "s.ini")).collect()}
    assert got[None, "top"].integer == 1 and got["first", "yes"].boolean is True and got["second", "yes"].boolean is False
    assert got["first", "name"].text == "a b" and got["first", "size"].float == 2.5 and got["first", "none"].text is None


def test_csv_source_asks_for_addresses(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url,n\nhttp://a,1\n,2\n")
    assert [tuple(r) for r in files.works_from_csv(spark, str(tmp_path / "a.csv")).collect()] == [("http://a", 1)]
    (tmp_path / "b.csv").write_text("address\nx\n")
    with pytest.raises(ValueError):
        files.works_from_csv(spark, str(tmp_path / "b.csv"))


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(k, k % 3, "a") for k in range(9)], "id int, part int, v string")
    old.write.partitionBy("part").parquet(path)
    before = {str(p) for p in (tmp_path / "t").glob("part=*/*.parquet")}
    merged = spark.createDataFrame([(k, k % 3, "b" if k == 4 else "a") for k in range(9)], "id int, part int, v string")
    files.upsert_into(old, merged, path, "part")
    after = {str(p) for p in (tmp_path / "t").glob("part=*/*.parquet")}
    assert {p for p in before if "part=1/" not in p} == {p for p in after if "part=1/" not in p}
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "v").collect())) == [(k, "b" if k == 4 else "a") for k in range(9)]


def test_character_sets():
    text = "日本語のテキスト"
    assert B.decoded_bytes(text.encode("shift_jis"), None) == text
    assert B.decoded_bytes(text.encode("euc_jp"), "text/html; charset=EUC-JP") == text
    assert B.decoded_bytes(b'<meta charset="shift_jis">' + text.encode("shift_jis"), None).endswith(text)
    assert B.decoded_bytes(text.encode(), None) == text and B.decoded_bytes(None, None) is None
    assert "�" in B.decoded_bytes(b"\xff\xfe\xfd", "text/plain; charset=nonsense")


def test_selectors():
    html = '<div id="a"><h2>One</h2><ul class="x y"><li><a href="/1">A</a></li><li><a href="/2"><b>B</b></a></ul><h2>Two</h2><a href="/3" rel=next>C</a><br></div>'
    rule = R.SelectorRule("#a a", chapter_selector="h2")
    assert R.select_page(html, rule) == [(1, "1", "/1", "A", "One", None), (2, "2", "/2", "B", "One", None), (3, "3", "/3", "C", "Two", None)]
    assert [e.attributes["href"] for e in R.selected(R.parsed(html), "ul.y > li > a, a[rel=next]")] == ["/1", "/2", "/3"]
    assert R.value_of(R.parsed(html), "a[href^='/2']") == "B" and R.value_of(R.parsed(html), "p") == ""
    assert R.select_page("", rule) == []


def test_rule_settings():
    assert R.merged_settings({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}
    assert R.modern_template(r"/\\k<id>/\k<page>") == "/{id}/{page}"


@pytest.mark.parametrize(
    ("text", "want"),
    [("百二十三", 123), ("一億二千三百四十五万六千七百八十九", 123456789), ("二〇二四", 2024), ("十", 10), ("〇", 0), ("千", 1000), ("三兆", 3 * 10**12)],
)
def test_kanji_values(spark, text, want):
    assert int(one(spark, J.kanji_value(F.col("c0")), text)) == want


def test_kanji_numerals_come_back(spark):
    numbers = [*range(0, 1200, 7), 10**4, 10**8, 10**12, 10**16, 1001, 10**7, 123456789]
    df = spark.createDataFrame([(Decimal(n),) for n in numbers], "n decimal(38,0)")
    got = df.select("n", J.kanji_value(J.kanji_with_units(F.col("n"))).alias("v"), J.kanji_with_units(F.col("n")).alias("t")).collect()
    assert [int(r.v) for r in got] == numbers
    assert {int(r.n): r.t for r in got}[10**7] == "一千万" and {int(r.n): r.t for r in got}[1001] == "千一"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("あ\n「はい。\n　そう」", "　あ\n「はい。そう」"),
        ("値段は1000円、12人、1,200個", "　値段は千円、一二人、1,200個"),
        ("ＡＢ3とVIIの章", "　ＡＢ３とⅦの章"),
        ("This is a pen.", "　This is a pen."),
        ("漢字《かんじ》と｜言葉（ことば）", "　｜漢字《かんじ》と｜言葉《ことば》"),
        ("なに！？本当！！！", "　なに［＃縦中横］!?［＃縦中横終わり］　本当［＃縦中横］!!!［＃縦中横終わり］"),
        ("", ""),
    ],
)
def test_whole_conversion(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert J.converted(df, "t", settings={"half_indent": False}).first()[0] == want


def test_conversion_keeps_nulls_and_takes_hooks(spark):
    df = spark.createDataFrame([(None,), ("a",)], "t string")
    got = J.converted(df, "t", "subtitle", pairs=[("Ｘ", "Y")], before=lambda t, kind: F.replace(t, F.lit("a"), F.lit("X")), after=lambda t, kind: F.concat(t, F.lit(kind)))
    assert [r[0] for r in got.collect()] == [None, "Ysubtitle"]


def test_dates_and_times(spark):
    at = lambda text: one(spark, F.date_format(V.parsed_date(F.col("c0")), "yyyy-MM-dd HH:mm"), text)
    assert at("2024年03月04日(月) 05時06分") == "2024-03-04 05:06" and at("2024/03/04 05:06") == "2024-03-04 05:06"
    assert at("2024-03-04T05:06:07Z") == "2024-03-04 05:06" and at("soon") is None
    assert one(spark, F.date_format(V.next_time(F.to_timestamp_ntz("c0"), ["0600"]), "yyyy-MM-dd HH:mm"), "2024-01-01 07:00:00") == "2024-01-02 06:00"


def test_shrink_and_notification(spark):
    rows = spark.createDataFrame([("new", f"t{k}") for k in range(7)] + [("error", "e")], "kind string, title string")
    assert {r.kind: r.line for r in S.notification(rows).collect()} == {"new": "new (7): t0, t1, t2, t3, t4 +2 more", "error": "error (1): e"}
    assert one(spark, S.shrink(F.lit(5), F.lit(3), F.col("c0")), "freeze") == "freeze" and one(spark, S.shrink(F.lit(5), F.lit(3), F.col("c0")), "x") == "cancel"


@pytest.mark.parametrize(
    ("title", "want", "tags"),
    [
        ("【書籍化！】サンプル小説【アニメ化！】", "サンプル小説", ["書籍化！", "アニメ化！"]),
        ("【書籍化！】", "【書籍化！】", []),
        ("  【新連載】  テスト　タイトル  ", "テスト タイトル", ["新連載"]),
        ("作者＠書籍版発売中！", "作者", ["書籍版発売中！"]),
        ("ハズレ枠の【状態異常スキル】で", "ハズレ枠の【状態異常スキル】で", []),
        (None, "", []),
        ("作品（書籍化決定）", "作品", ["書籍化決定"]),
        ("『作品』「コミカライズ連載中」", "『作品』", ["コミカライズ連載中"]),
        ("作品 (書籍化)", "作品", ["書籍化"]),
        ("作品〈書籍化〉", "作品", ["書籍化"]),
        ("〖受賞＋重版！〗作品｟新連載｠", "作品", ["新連載", "受賞", "重版！"]),
        ("【書籍化＆本編】作品", "作品", ["書籍化＆本編"]),
        ("作品／アニメ化！／続き", "作品続き", ["アニメ化！"]),
        ("新連載 | 作品 - 一 // 二", "作品 - 一/ 二", ["新連載"]),
        ("作者＠一人＠書籍版発売中！", "作者＠一人", ["書籍版発売中！"]),
        ("「「書籍化」」作品", "」作品", ["「書籍化"]),
        ("【" + "あ" * 200 + "書籍化】作品", "【" + "あ" * 200 + "書籍化】作品", []),
        ("【第3巻】【第3巻】作品", "作品", ["第3巻"]),
    ],
)
def test_promotions(spark, title, want, tags):
    from quire.functions.titles import without_promotions

    df = spark.createDataFrame([(title,)], "t string")
    rest, found = without_promotions(F.col("t"))
    assert tuple(df.select(rest, found).first()) == (want, tags)


def test_entries_are_normalised_from_their_originals(spark):
    from quire.functions import titles

    schema = "id int, title string, author string, title_raw_latest string, title_original string, author_original string, promo_tags array<string>, promo_tags_title array<string>, promo_tags_author array<string>"
    rows = [(1, "【書籍化！】題【アニメ化！】", "筆者【受賞】", "【書籍化！】題【アニメ化！】", None, None, ["古い"], ["古い"], ["古い"]), (2, "題", None, None, "【特典】題", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    more = titles.keywords(F.lit("特典,\n 別 "), F.lit(None).cast("string"), F.lit("特典"))
    once = titles.normalised_entries(df, F.lit(True), more)
    got = {r.id: r for r in once.collect()}
    assert (got[1].title, got[1].author, got[1].promo_tags, got[1].promo_tags_author, got[1].updated) == ("題", "筆者", ["書籍化！", "アニメ化！", "受賞"], ["受賞"], True)
    assert (got[1].title_original, got[1].author_original) == ("【書籍化！】題【アニメ化！】", "筆者【受賞】")
    assert (got[2].title, got[2].author, got[2].promo_tags, got[2].updated) == ("題", "", ["特典"], True)
    again = titles.normalised_entries(once.drop("updated"), F.lit(True), more)
    assert [r.updated for r in again.collect()] == [False, False]
    back = {r.id: r for r in titles.normalised_entries(once.drop("updated"), F.lit(None).cast("boolean"), more).collect()}
    assert (back[1].title, back[1].author, back[1].promo_tags, back[2].title) == ("【書籍化！】題【アニメ化！】", "筆者【受賞】", [], "【特典】題")
    assert spark.range(1).select(more.alias("k")).first().k == ["特典", "別"]


def test_pages_without_a_script_and_hostile_page_numbers(spark):
    from quire.operators import rules as R

    state = "<script>(function({0}){{return {{title:{1},page:b}}}})({2})</script>"
    pages = [(1, "no script"), (2, state.format("a,b", "a", '"t",7')), (3, state.format("a,b", "a", '"t"')), (4, state.format("a,b,a", "a", '"first",8,"last"')), (5, None), (6, state.format("a,b", "z", '"t",9,10')), (7, state.format("a,b", "a", "not json"))]
    got = R.script_state(spark.createDataFrame(pages, "id int, html string"), "id", {"title": "string", "page": "bigint"})
    assert sorted(map(tuple, got.collect())) == [(1, None, None), (2, "t", 7), (3, "t", None), (4, "last", 8), (5, None, None), (6, None, 9), (7, None, None)]
    rows = [(1, "p=3 p=2"), (2, "p=2000000000"), (3, "p=99999999999999999999999999999999999999999999"), (4, "none"), (5, None), (6, "p=5")]
    df = spark.createDataFrame(rows, "id int, html string").select("id", R.page_range(r"p=(\d+)", "/{page}", 5).alias("pages"), R.too_many_pages(r"p=(\d+)", 5).alias("more"))
    got = {r.id: (len(r.pages), r.more) for r in df.collect()}
    assert got == {1: (2, False), 2: (4, True), 3: (4, True), 4: (0, False), 5: (0, False), 6: (4, False)}
