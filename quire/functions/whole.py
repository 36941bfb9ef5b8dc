"""The steps of :func:`quire.functions.japanese.converted` for one text, so that a whole conversion is one pass.

Each function does what the Column function of its name does, line ends of all kinds among it; tests hold them against each other.
Most texts lack what a step looks for, so steps look for single characters before they match patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.functions import brackets

#: Fixed values, as in :mod:`quire.functions.japanese`.
KANJI, DIGITS, FULL_DIGITS = "〇一二三四五六七八九", "0123456789", "０１２３４５６７８９"
#: Before a line and behind one, by the line ends that Java knows; behind the last line, which may have one more of them.
_ENDS = "\n\r\x85\u2028\u2029"
_BEGIN = rf"(?<![^{_ENDS}])(?!(?<=\r)\n)(?!\Z)"
_LAST = r"(?=[\r\x85\u2028\u2029]?\Z)"
_BLANKS = " 　\t"
_BLANK_LINE = re.compile(f"[{_BLANKS}]*{_LAST}")


def _table(of: str, to: str) -> dict[int, str]:
    return {ord(a): b for a, b in reversed(list(zip(of, to)))}


def _one_by_one(text: str, some: re.Pattern, table: dict[int, str]) -> str:
    """The text with each sign that the pattern finds replaced; for few different signs much faster than a translation."""
    for c in set(some.findall(text)):
        text = text.replace(c, table[ord(c)])
    return text


def _any(text: str, signs: str) -> bool:
    return any(c in text for c in signs)


def _odd_ends(text: str) -> bool:
    return _any(text, _ENDS[1:])


def _tcy(text: str) -> str:
    return f"［＃縦中横］{text}［＃縦中横終わり］"


_TRAILING = re.compile(f"[{_BLANKS}]++(?![^{_ENDS}])")


def trimmed_lines(text: str) -> str:
    if text.endswith(tuple(_BLANKS)) or any(b + "\n" in text for b in _BLANKS) or _odd_ends(text):
        return _TRAILING.sub("", text)
    return text


_THREE_BLANK = re.compile(f"(?:{_BEGIN}\\n){{3}}")


def packed_blanks(text: str) -> str:
    text = text.replace("\n\n", "\n")
    return _THREE_BLANK.sub("\n\n", text) if "\n\n\n" in text else text


def page_breaks(text: str, lines: int) -> str:
    return re.sub(f"(?:{_BEGIN}\\n){{{lines},}}", "［＃改頁］\n", text) if lines == 0 or "\n" * lines in text else text


@cache
def _kana() -> tuple[re.Pattern, list[tuple[str, str]], dict[int, str]]:
    from quire.functions.japanese import FULL_KANA, HALF_KANA

    pairs = [(a + "ﾞ", b) for a, b in zip("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎｳ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ")] + [(a + "ﾟ", b) for a, b in zip("ﾊﾋﾌﾍﾎ", "パピプペポ")]
    return re.compile(f"[{HALF_KANA}—]"), pairs, _table(HALF_KANA + "—", FULL_KANA + "―")


def full_width_kana(text: str) -> str:
    some, pairs, table = _kana()
    if not some.search(text):
        return text
    for a, b in pairs:
        text = text.replace(a, b)
    return text.translate(table)


def joined_brackets(text: str) -> str:
    from quire.functions.japanese import BRACKET_LENGTH, BRACKET_LINES

    for opening, closing in ("「」", "『』"):
        if opening in text and closing in text:
            text = brackets.join(text, opening, closing, BRACKET_LINES, BRACKET_LENGTH)
    return text


_COMMA_LINE = re.compile("([^、])、\\n　([^「『(（【<＜〈《≪・■…‥―　１-９一-九])")


def joined_lines(text: str) -> str:
    return _COMMA_LINE.sub(r"\1、\2", text) if "、\n　" in text else text


_ADDRESS = re.compile("https?://[A-Za-z0-9\\-._~:/?#@!$&*+,;=%]+")


@cache
def _hiding() -> tuple[dict[int, str], dict[int, str], dict[int, str], re.Pattern]:
    """Signs as private ones, signs of an address as private ones, the way back, and what finds any private one."""
    from quire.functions import japanese as J

    private = J._PRIVATE + J._PRIVATE_ADDRESS
    return _table(J._SIGNS, J._PRIVATE), _table(J._ADDRESS, J._PRIVATE_ADDRESS), _table(private, J._SIGNS + J._ADDRESS), re.compile(f"[{private}]")


def hidden(text: str) -> str:
    return text.translate(_hiding()[0])


def hidden_links(text: str) -> str:
    return _ADDRESS.sub(lambda m: f'<a href="{m.group()}">{m.group()}</a>'.translate(_hiding()[1]), text) if "http" in text else text


def shown(text: str) -> str:
    return _one_by_one(text, _hiding()[3], _hiding()[2])


def site_tags(text: str) -> str:
    return re.sub("<[KkPp][Bb][Rr]>", "\n", text.replace("【改ページ】", "")) if "【" in text or "<" in text else text


def roman_numerals(text: str) -> str:
    from quire.functions.japanese import ROMAN, ROMAN_SIGNS

    for word, sign in zip(ROMAN, ROMAN_SIGNS):
        out, end, size = [], 0, len(word)
        # what stands around a numeral belongs to it, so the next one needs its own
        at = text.find(word, 1)
        while 0 <= at < len(text) - size:
            before, after = text[at - 1], text[at + size]
            if (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha()):
                at = text.find(word, at + 1)
            else:
                out += [text[end:at], sign]
                end = at + size
                at = text.find(word, end + 2)
        if out:
            text = "".join(out) + text[end:]
    return text


_WORDS, _LETTER = re.compile("[A-Za-z0-9_.,!?'\" &:;\\-]+"), re.compile("[A-Za-z]")
_SIGN = re.compile("[0-9.,!?'\"&:;_-]")


@cache
def _full_letters() -> dict[int, str]:
    from quire.functions.japanese import FULL_LETTERS, LETTERS

    return _table(LETTERS, FULL_LETTERS)


def letters(text: str, keep_words: bool) -> str:
    from quire.functions.japanese import LONG_WORD

    hide, full = {chr(k): v for k, v in _hiding()[0].items()}, _full_letters()

    def change(m: re.Match) -> str:
        run = m.group()
        if not _LETTER.search(run):
            return run
        if keep_words or len(run) >= LONG_WORD or " " in run.strip(" "):
            return _SIGN.sub(lambda m: hide[m.group()], run)
        return run.translate(full)

    return _WORDS.sub(change, text)


def all_letters(text: str) -> str:
    return text.translate(_full_letters())


_TO_FULL, _TO_HALF, _TO_KANJI = _table(DIGITS, FULL_DIGITS), _table(FULL_DIGITS, DIGITS), _table(DIGITS + FULL_DIGITS, KANJI + KANJI)
_RUN_OF_DIGITS = re.compile("[0-9]+")


def full_width_digits(text: str, subtitle: bool = False) -> str:
    def change(m: re.Match) -> str:
        size = len(m.group())
        return _tcy(m.group()) if size == 2 or (subtitle and size == 3 and m.start() == 0) else m.group().translate(_TO_FULL)

    return _RUN_OF_DIGITS.sub(change, text)


def _with_neighbours(text: str, is_one: Callable[[str], object], change: Callable[[str, object], str]) -> str:
    """The lines that ``is_one`` finds something in changed, with blank lines before and behind them unless there are some; before, another one will do."""
    lines = text.split("\n")
    found = [is_one(x) for x in lines]
    if not any(found):
        return text
    blank = lambda k: k < 0 or k == len(lines) or _BLANK_LINE.match(lines[k])
    return "\n".join(x if not m else ("" if blank(k - 1) or found[k - 1] else "\n") + change(x, m) + ("" if blank(k + 1) else "\n") for k, (x, m) in enumerate(zip(lines, found)))


_NUMBER_LINE = re.compile(f"[{_BLANKS}]*([－―<＜〈\\-]*)([0-9０-９{KANJI}]{{1,3}})([－―>＞〉\\-]*){_LAST}")


def chapter_lines(text: str) -> str:
    """Hidden, until :func:`deep_lines`."""
    from quire.functions.japanese import _DEEP

    def change(x: str, m: re.Match) -> str:
        top, number, bottom = m.groups()
        if top[:1] and top[0] in "―－-":
            top, bottom = "― ", " ―"
        angles = {60: "〈", 62: "〉"}
        return _DEEP + top.translate(angles) + hidden(full_width_digits(number.translate(_TO_HALF))) + bottom.translate(angles)

    return _with_neighbours(text, _NUMBER_LINE.match, change)


def deep_lines(text: str) -> str:
    from quire.functions.japanese import _DEEP

    return text.replace(_DEEP, "　　　")


def decimals(text: str) -> str:
    if "." in text or "．" in text:
        for kind in ("0-9", "０-９", KANJI):
            text = re.sub(f"(?<=[{kind}])[.．](?=[{kind}])", "・", text)
    return text


_FULL_LETTER = "Ａ-Ｚａ-ｚ"
_IS_FULL_LETTER, _NEAR = re.compile(f"[{_FULL_LETTER}]"), re.compile(f"[{_FULL_LETTER}％㎜㎝㎞㎎㎏㏄㎡㎥]")
_NUMBER, _NUMBER_OR_COMMA, _NUMERAL = re.compile("[0-9０-９・～]+"), re.compile("[0-9０-９,，]+"), re.compile(f"[{KANJI}十百千万億兆京]+")
_PLACES, _UNITS = {"十": 10, "百": 100, "千": 1000}, {"万": 10**4, "億": 10**8, "兆": 10**12, "京": 10**16}
#: Numerals from here on stay as they are.
_MOST = 10**20


def numbers(text: str, zeros: int | None = None) -> str:
    def near(m: re.Match) -> str:
        a, b = m.span()
        beside = (a > 0 and _IS_FULL_LETTER.match(text, a - 1)) or _NEAR.match(text, b)
        return hidden(m.group().translate(_TO_FULL)) if beside else m.group()

    def plain(m: re.Match) -> str:
        run = m.group()
        if "," in run or "，" in run:
            return hidden(run.replace("，", ",")) if _RUN_OF_DIGITS.search(run) else run
        return run.translate(_TO_KANJI)

    if _NEAR.search(text):
        text = _NUMBER.sub(near, text)
    text = _NUMBER_OR_COMMA.sub(plain, text)
    return text if zeros is None else numerals_with_units(text, zeros)


def kanji_value(run: str) -> int:
    """The integer that a numeral stands for; of digits in a row, :data:`_MOST` at most."""
    whole, part, digits = 0, 0, None
    for c in run:
        if (d := KANJI.find(c)) >= 0:
            digits = min((digits or 0) * 10 + d, _MOST)
        elif c in _PLACES:
            part, digits = part + (1 if digits is None else digits) * _PLACES[c], None
        else:
            whole, part, digits = whole + (part + (digits or 0) or 1) * _UNITS[c], 0, None
    return whole + part + (digits or 0)


def kanji_with_units(number: int) -> str:
    if number == 0:
        return "〇"
    digits = str(number)
    size = -(-len(digits) // 4)
    digits, out = digits.zfill(4 * size), []
    for g in range(size):
        four = ""
        for d, place in zip(digits[4 * g : 4 * g + 4], ("千", "百", "十", "")):
            if d == "1":
                four += ("一千" if size > 1 else "千") if place == "千" else place or "一"
            elif d != "0":
                four += KANJI[int(d)] + place
        out.append(four and four + ("", *_UNITS)[size - g - 1])
    return "".join(out)


def numerals_with_units(text: str, zeros: int = 0) -> str:
    """Numerals of up to 20 digits; longer ones stay."""

    def change(m: re.Match) -> str:
        run = m.group()
        value = _MOST if run[0] in _UNITS else kanji_value(run)
        return kanji_with_units(value) if value < _MOST and str(value).endswith("0" * zeros) else run

    return _NUMERAL.sub(change, text)


@cache
def _after_mark() -> re.Pattern:
    from quire.functions.japanese import AFTER_MARK

    return re.compile(f"(?<=[!?！？])(?=[^!?！？{AFTER_MARK}])")


def space_after_marks(text: str) -> str:
    if not _any(text, "!?！？"):
        return text
    return _after_mark().sub("　", re.sub("(?<=[!?！？])[ 、。]", "　", text))


def notes_hidden(text: str) -> str:
    return angle_notes(text.replace("※", "※※"))


def angle_notes(text: str) -> str:
    return text.replace("≪", "※［＃始め二重山括弧］").replace("≫", "※［＃終わり二重山括弧］")


def notes_shown(text: str) -> str:
    return text.replace("※※", "※［＃米印、1-2-8］")


@cache
def _symbols() -> tuple[re.Pattern, dict[int, str]]:
    from quire.functions.japanese import FULL_SYMBOLS, HALF_SYMBOLS

    return re.compile(f"[{re.escape(HALF_SYMBOLS)}]"), _table(HALF_SYMBOLS, FULL_SYMBOLS)


def full_width_symbols(text: str) -> str:
    for quotes in ("‘’'", '“”〝〟"'):
        if _any(text, quotes):
            text = re.sub(f'[{quotes}]([^"\\n]+?)[{quotes}]', r"〝\1〟", text)
    return _one_by_one(text, *_symbols())


_ALONE = "(?<!？)(?<!！){}(?![！？])"


def upright_marks(text: str) -> str:
    if "！" not in text and "？" not in text:
        return text
    text = re.sub(_ALONE.format("！{3}"), _tcy("!!!"), text)
    text = re.sub(_ALONE.format("((?:！！){2,})！"), r"\1！！", text)
    text = re.sub(_ALONE.format("！{4,}"), lambda m: _tcy("!!") * (len(m.group()) // 2) + "！" * (len(m.group()) % 2), text)
    for run in ("！！", "！？", "？！", "？？", "！！？", "？！！"):
        text = re.sub(_ALONE.format(run), _tcy(run.translate({0xFF01: "!", 0xFF1F: "?"})), text)
    return text


def even_ellipses(text: str) -> str:
    if "。" in text:
        text = re.sub("。([」』）])", r"\1", text)
    for dot in "…‥":
        if dot in text:
            text = re.sub(f"{dot}+", lambda m: m.group() + m.group()[0] * (len(m.group()) % 2), text)
    return text.replace("。　", "。")


_HEAD = re.compile(f"{_BEGIN} +")


def head_spaces(text: str) -> str:
    if text.startswith(" ") or "\n " in text or _odd_ends(text):
        return _HEAD.sub(lambda m: "　" * ((len(m.group()) + 1) // 2), text)
    return text


def kana_two(text: str) -> str:
    return re.sub("([^ァ-ヶー]{2})ニ([^ァ-ヶー]{2})", r"\1二\2", text) if "ニ" in text else text


def voiced_marks(text: str) -> str:
    return re.sub("([ぁ-んァ-ヶι])[゛ﾞ]", r"［＃濁点］\1［＃濁点終わり］", text)


def long_marks_to_dashes(text: str) -> str:
    return re.sub("ー{2,}", lambda m: "―" * len(m.group()), text)


@cache
def _borders() -> tuple[str, re.Pattern]:
    from quire.functions.japanese import BORDERS

    return BORDERS, re.compile(f"[{_BLANKS}]*[{BORDERS}]++[{_BLANKS}{BORDERS}]*{_LAST}")


def border_lines(text: str) -> str:
    signs, line = _borders()
    if not _any(text, signs):
        return text
    return _with_neighbours(text, line.match, lambda x, _: "　　　　" + x.lstrip(_BLANKS))


@cache
def _opened() -> tuple[str, re.Pattern]:
    from quire.functions.japanese import OPENED

    return OPENED, re.compile(f"{_BEGIN}[{_BLANKS}]*([{OPENED}]|※［＃始め二重山括弧］)")


def bracket_indents(text: str, half: bool = True) -> str:
    signs, pattern = _opened()
    if not _any(text, signs) and "※［＃始め二重山括弧］" not in text:
        return text
    return pattern.sub(("［＃二分アキ］" if half else "") + r"\1", text)


@cache
def _plain_line() -> tuple[str, re.Pattern]:
    from quire.functions.japanese import NO_INDENT

    return NO_INDENT, re.compile(f"{_BEGIN}(?:[ 　]|(?=[^{NO_INDENT.replace('・', '')}\\n])(?!・(?!・)))")


_DASHED = re.compile(f"{_BEGIN}[{_BLANKS}]*(――)")


def indented(text: str, always: bool = False) -> str:
    none, pattern = _plain_line()
    if "――" in text:
        text = _DASHED.sub(r"　\1", text)
    if not always:
        first = [x[0] for x in text.split("\n") if x and x[0] not in none]
        if not first or sum(c not in " 　" for c in first) / len(first) <= 0.5:
            return text
    if _odd_ends(text):
        return pattern.sub("　", text)
    return "\n".join(pattern.sub("　", x[:2]) + x[2:] if x else x for x in text.split("\n"))


_BASE, _KANA = "一-龠Ａ-Ｚａ-ｚA-Za-z", "ぁ-んァ-ヶーゝゞ・"
_MARK = "\u0001"


def _emphasised(text: str) -> str:
    for found, reading in ((("≪・", "≪、"), "≪[・、]+≫"), (("（・",), "（・{1,20}）")):
        if any(x in text for x in found):
            text = re.sub(f"｜([^｜≪≫（）\\n]+){reading}", r"［＃傍点］\1［＃傍点終わり］", text)
            text = re.sub(f"([{_BASE}][{_BASE}　]*+){reading}", r"［＃傍点］\1［＃傍点終わり］", text)
    return text


def ruby(text: str, large: bool = False) -> str:
    text = _emphasised(text)
    part, kana = f"(?<![{_BASE}{_MARK}])([{_BASE}]++)", f"[{_KANA}]+"
    for opening, closing, marked in (("≪", "≫", "[^≪≫\\n]+?"), ("（", "）", f"[{_KANA} 　]{{1,20}}")):
        if opening not in text:
            continue
        if "｜" in text:
            text = re.sub(f"｜([^｜≪≫（）《》\\n]+){opening}(?! )({marked})(?<!  ){closing}", rf"{_MARK}\1《\2》", text)
        if re.search(f"{opening}[{_KANA}]", text):
            short = f"(?=[^{closing}]{{1,20}}{closing})"
            text = re.sub(f"{part}([ 　])([{_BASE}]++){opening}{short}({kana})[ 　]({kana}){closing}", rf"{_MARK}\1《\4》\2{_MARK}\3《\5》", text)
            text = re.sub(f"{part}{opening}{short}({kana}[ 　]?[{_KANA}]*){closing}", rf"{_MARK}\1《\2》", text)
    if "｜" in text:
        text = re.sub("｜([≪（])", r"\1", text)
    if large:
        from quire.functions.japanese import LARGE_KANA, SMALL_KANA

        text = re.sub("《[^《》]*》?", lambda m: m.group().translate(_table(SMALL_KANA, LARGE_KANA)), text)
    return text.replace("｜", "※［＃縦線］").replace(_MARK, "｜")


def ellipses(text: str) -> str:
    for dot in "・。、．":
        if dot * 3 in text:
            text = re.sub(f"(?<![{dot}―]){dot}{{3,}}+(?![{dot}―])", lambda m: "……" * -(-len(m.group()) // 6), text)
    return text.replace("。。", "。").replace("、、", "、")


def without_dust(text: str) -> str:
    return text.replace("︎", "")


def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = text.replace(a, b) if a else text
    return text


#: Bytes of texts that are converted at once.
AT_ONCE = 1 << 20


def applied(df: DataFrame, column: str, steps: list[Callable[[str], str]]) -> DataFrame:
    """``df`` with the steps applied to a column's texts, one after the other; null texts stay null."""

    def convert(text: str | None) -> str | None:
        if text is not None:
            for step in steps:
                text = step(text)
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            begin = size = 0
            for k, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
                size += n or 0
                if size >= AT_ONCE or k == batch.num_rows - 1:
                    some = batch.slice(begin, k + 1 - begin)
                    texts = pa.array([convert(x) for x in some.column(at).to_pylist()], pa.string())
                    yield pa.RecordBatch.from_arrays([texts if c == at else x for c, x in enumerate(some.columns)], batch.schema.names)
                    begin, size = k + 1, 0

    return df.mapInArrow(run, df.schema)
