"""Steps over whole texts against the Column functions of their names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import japanese as J
from quire.functions import whole as W

PIECES = [
    *"  　\t\n\n\n\r\u0085\u2028・。、．.,!?！？'\"“‘「」『』（）()《》≪≫<>＜＞【】〔―ーー…‥※｜|*＊☆◇♪→ニｶﾞﾊﾟ｢—゛ιあんアヶ山林一二十百千万億〇１２９09é-－:;&_%～ＡｚIvx／/㎞\ue001\ufe0e😀",
    "、\n　", "\r\n", "II", " iv ", "viii", " the word", "abc", "ab cd", "http://a.b/c?d=1,2", "【改ページ】", "<kbr>", "2024", "1,000", "３，０００", "五千〇百", "000", "――", "！！！", "・・・", "。。。。", "（もり）", "（・・）", "≪・、≫", "（もり はやし）", "森　林", "※［＃始め二重山括弧］", "［＃深］", "\n－12－\n", "\n◇◆\n", "    ", "四" * 45, "\n\n\n\n", "「あ\nい」", "ニュース", "漢字ニ漢字",
]


def texts(count, seed=1):
    pick = random.Random(seed)
    return ["", "\n", " ", *("".join(pick.choices(PIECES, k=pick.randint(1, 25))) for _ in range(count))]


STEPS = {
    "trimmed_lines": (J.trimmed_lines, W.trimmed_lines),
    "packed_blanks": (J.packed_blanks, W.packed_blanks),
    "page_breaks": (lambda t: J.page_breaks(t, 2), lambda t: W.page_breaks(t, 2)),
    "full_width_kana": (J.full_width_kana, W.full_width_kana),
    "joined_brackets": (J.joined_brackets, W.joined_brackets),
    "joined_lines": (J.joined_lines, W.joined_lines),
    "hidden_links": (J.hidden_links, W.hidden_links),
    "shown": (J.shown, W.shown),
    "site_tags": (J.site_tags, W.site_tags),
    "roman_numerals": (J.roman_numerals, W.roman_numerals),
    "letters": (lambda t: J.letters(t, False, True), lambda t: W.letters(t, False)),
    "kept_words": (lambda t: J.letters(t, True, True), lambda t: W.letters(t, True)),
    "all_letters": (J.all_letters, W.all_letters),
    "chapter_lines": (lambda t: J.chapter_lines(t, True), W.chapter_lines),
    "decimals": (J.decimals, W.decimals),
    "numbers": (J.numbers, W.numbers),
    "numbers_with_units": (lambda t: J.numbers(t, 3), lambda t: W.numbers(t, 3)),
    "numerals_with_units": (J.numerals_with_units, W.numerals_with_units),
    "full_width_digits": (J.full_width_digits, W.full_width_digits),
    "digits_of_subtitles": (lambda t: J.full_width_digits(t, True), lambda t: W.full_width_digits(t, True)),
    "space_after_marks": (J.space_after_marks, W.space_after_marks),
    "notes": (lambda t: J.notes_shown(J.notes_hidden(t)), lambda t: W.notes_shown(W.notes_hidden(t))),
    "full_width_symbols": (J.full_width_symbols, W.full_width_symbols),
    "upright_marks": (J.upright_marks, W.upright_marks),
    "even_ellipses": (J.even_ellipses, W.even_ellipses),
    "head_spaces": (J.head_spaces, W.head_spaces),
    "kana_two": (J.kana_two, W.kana_two),
    "voiced_marks": (J.voiced_marks, W.voiced_marks),
    "long_marks_to_dashes": (J.long_marks_to_dashes, W.long_marks_to_dashes),
    "border_lines": (J.border_lines, W.border_lines),
    "bracket_indents": (J.bracket_indents, W.bracket_indents),
    "indented": (J.indented, W.indented),
    "always_indented": (lambda t: J.indented(t, True), lambda t: W.indented(t, True)),
    "ruby": (J.ruby, W.ruby),
    "large_ruby": (lambda t: J.ruby(t, True, True), lambda t: W.ruby(t, True)),
    "ellipses": (J.ellipses, W.ellipses),
    "angle_notes": (J.angle_notes, W.angle_notes),
    "without_dust": (J.without_dust, W.without_dust),
}


@pytest.mark.parametrize("name", STEPS)
def test_step_is_the_column_function(spark, name):
    column, whole = STEPS[name]
    # the Column function cannot hold numerals of over 38 digits
    rows = [(t,) for t in texts(1500, name) if "units" not in name or "四" * 30 not in t]
    got = spark.createDataFrame(rows, "t string").select("t", column(F.col("t")).alias("c")).collect()
    assert [(r.t, whole(r.t)) for r in got] == [(r.t, r.c) for r in got]


def test_long_numerals_stay(spark):
    for text in ("四" * 45, "四" * 21, "四" * 5000 + "万"):
        assert W.numbers(text, 0) == text
    assert W.numbers("二〇〇〇万と五〇〇〇と万", 3) == "二千万と五千と万"


def test_conversion_of_many_numbers_is_fast(spark):
    """A million characters with a number in each ten, in seconds on one core."""
    text = "漢字と12345と、é12 000 words, two!\n" * 30_000
    df = spark.createDataFrame([(text,), (None,)], "t string").coalesce(1)
    began = time.time()
    got = [r.t for r in J.converted(df, "t").collect()]
    assert time.time() - began < 15 and got[1] is None and got[0].count("一万二千三百四十五") == 0 and got[0].count("一二三四五") == 30_000
