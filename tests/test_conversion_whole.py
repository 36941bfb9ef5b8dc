import pytest
from pyspark.sql import functions as F

from quire.functions import japanese as J
from quire.functions.separators import BY_CHARACTER, BY_WORD, marked


def converted(spark, text, kind="textfile", **settings):
    return J.converted(spark.createDataFrame([(text,)], "t string"), "t", kind, settings).first().t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("［＃改ページ］\n題\n本文だ！\n次の文。\n", "［＃改ページ］\n\n［＃３字下げ］［＃中見出し］題［＃中見出し終わり］\n\n\n　本文だ！\n　次の文。\n"),
        ("　彼は言った、\n\n　聞いていた。\n", "　彼は言った、聞いていた。\n"),
        ("あ。\n\n\n〈12〉\n\n\n<350>\n\n\nい。\n", "　あ。\n\n　　　〈［＃縦中横］12［＃縦中横終わり］〉\n\n　　　〈３５０〉\n\n　い。\n"),
        ("　五〇〇万千と三千万と東京と億千万。\n", "　五百万一千と三千万と東京と億千万。\n"),
        ("　頁は iii iv、章は IX。\n", "　頁は ⅲ ⅳ、章は Ⅸ。\n"),
        ("http://a.example/x?y=1&z=2 を見よ。\n", '　<a href="http://a.example/x?y=1&z=2">http://a.example/x?y=1&z=2</a> を見よ。\n'),
    ],
)
def test_whole_conversion(spark, text, want):
    got = converted(spark, text)
    if text.startswith("http"):
        want = want.removeprefix("　")
        got = got.removeprefix("　")
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("森 林（もり はやし）", "｜森《もり》 ｜林《はやし》"),
        ("森　林《もり　はやし》".translate(str.maketrans("《》", "≪≫")), "｜森《もり》　｜林《はやし》"),
        ("森　林（もりはやし）", "森　｜林《もりはやし》"),
        ("森林（もり　はやし）", "｜森林《もり　はやし》"),
        ("｜森　林（もり　はやし）", "｜森　林《もり　はやし》"),
        ("森林（ もり）", "森林（ もり）"),
        ("森林（もり  ）", "森林（もり  ）"),
        ("森林（・・）と森林（、、）", "［＃傍点］森林［＃傍点終わり］と森林（、、）"),
        ("森林｜（もり）", "森林（もり）"),
        ("森林（" + "も" * 21 + "）", "森林（" + "も" * 21 + "）"),
    ],
)
def test_readings(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(J.ruby(F.col("t")).alias("t")).first().t == want


def test_separators(spark):
    z = "［＃zws］"
    assert marked("言葉。「山の人」12ab cd、ー", BY_WORD) == f"言葉{z}。「山{z}の{z}人{z}」{z}12{z}ab cd{z}、ー"
    assert marked("a［＃太字］b<i>、｜山《やま》", BY_WORD) == f"a{z}［＃太字］b{z}<i>、{z}｜山《やま》{z}"
    assert marked("あ…い｜山《やま》", BY_CHARACTER) == f"あ{z}…{z}い{z}｜山《やま》"
    assert converted(spark, "　言葉だ。\n", "body", separators=True) == f"　{z}言葉{z}だ{z}。\n"


def test_foreword_and_heading(spark):
    text = "［＃改ページ］\n［＃ここから前書き］\n前\n［＃ここで前書き終わり］\n題\n文\n"
    got = spark.createDataFrame([(text,)], "t string").select(J.spaced_headings(F.col("t")).alias("t")).first().t
    assert got == "［＃改ページ］\n［＃３字下げ］［＃中見出し］題［＃中見出し終わり］［＃ここから前書き］\n前\n［＃ここで前書き終わり］\n\n文\n"
