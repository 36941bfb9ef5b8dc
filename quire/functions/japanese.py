"""Conversion of Japanese text for vertical setting, as Column expressions.

Each function takes and gives a Column.  Texts are cut into pieces with look-around
patterns where a piece needs more than a replacement, so each step stays in the JVM; the whole
conversion is one pass over each text instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import brackets
from quire.functions import whole as W
from quire.functions.separators import separated

#: Digits, units, and characters with their other widths, in the same order.
KANJI, DIGITS, FULL_DIGITS = "〇一二三四五六七八九", "0123456789", "０１２３４５６７８９"
PLACES, UNITS = ("", "十", "百", "千"), ("", "万", "億", "兆", "京")
HALF_SYMBOLS = "-=+/*《》'\"%$#&!?<>＜＞()|‐,._;:[]{}\\"
FULL_SYMBOLS = "－＝＋／＊≪≫'〝％＄＃＆！？〈〉〈〉（）｜－，．＿；：［］｛｝￥"
HALF_KANA = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
SMALL_KANA = "ぁぃぅぇぉゃゅょゎっァィゥェォャュョヮッヵヶ"
LARGE_KANA = "あいうえおやゆよわつアイウエオヤユヨワツカケ"
ROMAN = "II III IV VI VII VIII IX ii iii iv vi vii viii ix".split()
ROMAN_SIGNS = "ⅡⅢⅣⅥⅦⅧⅨⅱⅲⅳⅵⅶⅷⅸ"
NO_INDENT, BORDERS = "(（「『〈《≪【〔―・※［〝", "■□◆◇○◎●★☆*＊※♡♥❤∽♤♠§♯"
OPENED, AFTER_MARK = "〔「『(（【〈《≪〝", "」］｝\\]\\}』】〉》〕＞>≫)）\"”’〟　☆★♪［―"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
FULL_LETTERS = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
#: An English word of so many letters stays as it is; brackets with so many lines or characters are not joined.
LONG_WORD, BRACKET_LINES, BRACKET_LENGTH = 8, 7, 400
_MARK = "\u0001"


def _pieces(text: Column, inside: str) -> Column:
    """The text cut into runs of the class and of everything else, in order."""
    return F.split(text, f"(?<=[{inside}])(?=[^{inside}])|(?<=[^{inside}])(?=[{inside}])")


def _near_letters(text: Column, inside: str, change) -> Column:
    """The text with ``change`` applied to each run of the class behind a full-width letter, or before one or a sign of measure."""
    letter = "Ａ-Ｚａ-ｚ"
    run = f"(?<=[{letter}])[{inside}]++|(?<![{inside}])[{inside}]++(?=[{letter}％㎜㎝㎞㎎㎏㏄㎡㎥])"
    marked = F.regexp_replace(text, run, f"{_MARK}$0{_MARK}")
    return F.array_join(F.transform(F.split(marked, _MARK), lambda p, i: F.when(i % 2 == 1, change(p)).otherwise(p)), "")


def _with_neighbours(lines: Column, change) -> Column:
    """``change`` of each line, the one before and the one behind it (null at the ends)."""
    some = F.greatest(F.size(lines) - 1, F.lit(0))
    none = F.array(F.lit(None).cast("string"))
    near = F.arrays_zip(lines.alias("own"), F.concat(none, F.slice(lines, F.lit(1), some)).alias("before"), F.concat(F.slice(lines, F.lit(2), some), none).alias("after"))
    kind = "array<struct<own:string,before:string,after:string>>"
    return F.transform(near.cast(kind), lambda x: change(x["own"], x["before"], x["after"]))


def _each_run(text: Column, inside: str, change) -> Column:
    """The text with ``change`` applied to each run of the class."""
    return F.array_join(F.transform(_pieces(text, inside), lambda p: F.when(p.rlike(f"^[{inside}]"), change(p)).otherwise(p)), "")


def _by_steps(text: Column, run: str, step: str, to: str) -> Column:
    """Within each match of ``run`` every ``step`` becomes ``to``."""
    return F.regexp_replace(F.regexp_replace(text, run, _MARK + "$0"), f"(?:{_MARK}|(?!^)\\G){step}", to)


def _tcy(text: str) -> str:
    return f"［＃縦中横］{text}［＃縦中横終わり］"


def trimmed_lines(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)[ 　\\t]+$", "")


def full_width_kana(text: Column) -> Column:
    voiced = list(zip("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎｳ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"))
    text = reduce(lambda t, p: F.replace(t, F.lit(p[0] + "ﾞ"), F.lit(p[1])), voiced, text)
    text = reduce(lambda t, p: F.replace(t, F.lit(p[0] + "ﾟ"), F.lit(p[1])), zip("ﾊﾋﾌﾍﾎ", "パピプペポ"), text)
    return F.translate(text, HALF_KANA + "—", FULL_KANA + "―")


def full_width_symbols(text: Column) -> Column:
    for quotes in ("‘’'", '“”〝〟"'):
        text = F.regexp_replace(text, f'[{quotes}]([^"\\n]+?)[{quotes}]', "〝$1〟")
    return F.translate(text, HALF_SYMBOLS, FULL_SYMBOLS)


def upright_marks(text: Column) -> Column:
    """Runs of exclamation and question marks that stand upright in a vertical line."""
    alone = "(?<!？)(?<!！){}(?![！？])"
    text = F.regexp_replace(text, alone.format("！{3}"), _tcy("!!!"))
    text = F.regexp_replace(text, alone.format("((?:！！){2,})！"), "$1！！")
    text = _by_steps(text, alone.format("！{4,}"), "！！", _tcy("!!"))
    for run in ("！！", "！？", "？！", "？？", "！！？", "？！！"):
        text = F.regexp_replace(text, alone.format(run), _tcy(run.translate(str.maketrans("！？", "!?"))))
    return text


def even_ellipses(text: Column) -> Column:
    """No full stop before a closing bracket, dots in pairs, no space after a full stop."""
    text = F.regexp_replace(text, "。([」』）])", "$1")
    for dot in "…‥":
        text = F.regexp_replace(text, f"(?<!{dot})((?:{dot}{dot})*){dot}(?!{dot})", f"$1{dot}{dot}")
    return F.replace(text, F.lit("。　"), F.lit("。"))


def arrows(text: Column) -> Column:
    return F.translate(text, "⇒⇐", "→←")


def head_spaces(text: Column) -> Column:
    """Half spaces at the beginning of a line: half as many full ones, rounded up."""
    return F.regexp_replace(text, "(?m)(?:^|\\G(?!^)) {1,2}", "　")


def notes_hidden(text: Column) -> Column:
    """Reference marks doubled, double angle quotes as notes; :func:`notes_shown` ends it."""
    text = F.replace(text, F.lit("※"), F.lit("※※"))
    return angle_notes(text)


def angle_notes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("≪"), F.lit("※［＃始め二重山括弧］")), F.lit("≫"), F.lit("※［＃終わり二重山括弧］"))


def notes_shown(text: Column) -> Column:
    return F.replace(text, F.lit("※※"), F.lit("※［＃米印、1-2-8］"))


def roman_numerals(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"([^a-zA-Z]){p[0]}([^a-zA-Z])", f"$1{p[1]}$2"), zip(ROMAN, ROMAN_SIGNS), text)


def letters(text: Column, keep_words: bool = False, hide: bool = False) -> Column:
    """English words in full width, but for long ones and for several together; ``hide``: see :func:`hidden`."""
    inside = "A-Za-z0-9_.,!?'\" &:;\\-"

    def change(run: Column) -> Column:
        words = F.size(F.filter(F.split(run, " +"), lambda w: w != ""))
        long = (F.length(run) >= LONG_WORD) | F.lit(keep_words)
        return F.when(((words >= 2) | long) & run.rlike("[A-Za-z]"), hidden(run) if hide else run).otherwise(F.translate(run, LETTERS, FULL_LETTERS))

    return _each_run(text, inside, change)


#: Signs that later steps would change, and private ones that stand for them meanwhile.
_SIGNS = DIGITS + FULL_DIGITS + ".,!?'\"&:;-_"
_PRIVATE = "".join(chr(0xE000 + k) for k in range(len(_SIGNS)))


#: All signs of an address, and private ones that stand for them.
_ADDRESS = "".join(map(chr, range(0x20, 0x7F)))
_PRIVATE_ADDRESS = "".join(chr(0xE100 + k) for k in range(len(_ADDRESS)))


def hidden(text: Column) -> Column:
    """Digits and signs kept from later steps; :func:`shown` ends it."""
    return F.translate(text, _SIGNS, _PRIVATE)


def shown(text: Column) -> Column:
    return F.translate(text, _PRIVATE + _PRIVATE_ADDRESS, _SIGNS + _ADDRESS)


def numbers(text: Column, zeros: int | None = None) -> Column:
    """Digits as Kanji, with units if they end in so many zeros; those with commas stay, those near letters are full width."""
    near = _near_letters(text, "0-9０-９・～", lambda p: hidden(F.translate(p, DIGITS, FULL_DIGITS)))

    def change(p: Column) -> Column:
        plain = F.translate(p, DIGITS + FULL_DIGITS, KANJI + KANJI)
        return F.when(p.rlike("[,，]"), F.when(p.rlike("[0-9]"), hidden(F.translate(p, "，", ","))).otherwise(p)).otherwise(plain)

    text = _each_run(near, "0-9０-９,，", change)
    return text if zeros is None else numerals_with_units(text, zeros)


def all_letters(text: Column) -> Column:
    return F.translate(text, LETTERS, FULL_LETTERS)


def full_width_digits(text: Column, subtitle: bool = False) -> Column:
    """Digits in full width; two together stand upright, three too at the beginning of a subtitle."""
    if subtitle:
        text = F.regexp_replace(text, r"^(\d{3})(?!\d)", _tcy("$1").replace("$1", f"{_MARK}$1{_MARK}"))
    marked = F.regexp_replace(text, f"(?<![\\d{_MARK}])(\\d\\d)(?![\\d{_MARK}])", _tcy(f"{_MARK}$1{_MARK}"))
    shown = F.array_join(F.transform(F.split(marked, _MARK), lambda p, i: F.when(i % 2 == 0, F.translate(p, DIGITS, FULL_DIGITS)).otherwise(p)), "")
    return shown


def decimals(text: Column) -> Column:
    """A point between two digits of one kind becomes a middle dot."""
    for kind in ("0-9", "０-９", KANJI):
        text = F.regexp_replace(text, f"(?<=[{kind}])[.．](?=[{kind}])", "・")
    return text


def kanji_digits(text: Column) -> Column:
    """Digits as Kanji; those with commas stay."""
    plain = lambda p: F.translate(p, DIGITS + FULL_DIGITS, KANJI + KANJI)
    change = lambda p: F.when(p.rlike("[,，]"), F.when(p.rlike("[0-9]"), F.translate(p, "，", ",")).otherwise(p)).otherwise(plain(p))
    return _each_run(text, "0-9０-９,，", change)


def kanji_value(text: Column) -> Column:
    """The integer that a Kanji numeral stands for: digits in a row, places and units."""
    zero, ten = F.lit(0).cast("decimal(38,0)"), F.lit(10).cast("decimal(38,0)")
    state = F.struct(zero.alias("all"), zero.alias("part"), F.lit(None).cast("decimal(38,0)").alias("digits"))

    def power(c: Column, signs: tuple[str, ...], step: int) -> Column:
        return reduce(lambda rest, k: F.when(c == signs[k], F.lit(str(10 ** (k * step))).cast("decimal(38,0)")).otherwise(rest), range(1, len(signs)), F.lit(None).cast("decimal(38,0)"))

    def read(s: Column, c: Column) -> Column:
        digit = F.when(c == "", -1).otherwise(F.instr(F.lit(KANJI), c) - 1)
        place, unit = power(c, PLACES, 1), power(c, UNITS, 4)
        d = F.coalesce(s["digits"], F.lit(0)).cast("decimal(38,0)")
        one = F.coalesce(s["digits"], F.lit(1)).cast("decimal(38,0)")
        as_digit = F.struct(s["all"].alias("all"), s["part"].alias("part"), (d * ten + digit).cast("decimal(38,0)").alias("digits"))
        as_place = F.struct(s["all"].alias("all"), (s["part"] + one * place).cast("decimal(38,0)").alias("part"), F.lit(None).cast("decimal(38,0)").alias("digits"))
        whole = s["part"] + d
        as_unit = F.struct((s["all"] + F.when(whole == 0, F.lit(1)).otherwise(whole) * unit).cast("decimal(38,0)").alias("all"), zero.alias("part"), F.lit(None).cast("decimal(38,0)").alias("digits"))
        return F.when(digit >= 0, as_digit).when(place.isNotNull(), as_place).when(unit.isNotNull(), as_unit).otherwise(s)

    end = lambda s: (s["all"] + s["part"] + F.coalesce(s["digits"], F.lit(0))).cast("decimal(38,0)")
    return F.aggregate(F.split(text, ""), state, read, end)


def kanji_with_units(number: Column) -> Column:
    """An integer as a Kanji numeral with places and units; up to 20 digits."""
    digits = number.cast("string")
    size = F.ceil(F.length(digits) / 4).cast("int")
    padded = F.lpad(digits, size * 4, "0")

    def four(g: Column) -> Column:
        def sign(k: int) -> Column:
            d = F.substr(padded, g * 4 + k + 1, F.lit(1))
            place = PLACES[3 - k]
            bare = F.lit(place) if place and place != "千" else (F.when(size > 1, "一千").otherwise("千") if place else F.lit("一"))
            return F.when(d == "0", "").when(d == "1", bare).otherwise(F.concat(F.translate(d, DIGITS, KANJI), F.lit(place)))

        text = F.concat(*(sign(k) for k in range(4)))
        unit = F.element_at(F.array(*map(F.lit, UNITS)), size - g)
        return F.when(text == "", "").otherwise(F.concat(text, unit))

    return F.when(number == 0, "〇").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), four), ""))


def numerals_with_units(text: Column, zeros: int = 0) -> Column:
    """Kanji numerals that end in so many zeros with places and units; very long ones stay."""

    def change(run: Column) -> Column:
        value = kanji_value(run)
        digits = value.cast("string")
        # a unit needs a number before it
        counts = ~run.rlike("^[万億兆京]") & (F.length(digits) <= 20) & digits.rlike(f"0{{{zeros},}}$")
        return F.when(counts, kanji_with_units(value)).otherwise(run)

    return _each_run(text, KANJI + "十百千万億兆京", change)


def fractions_and_dates(text: Column, fractions: bool = True, dates: bool = True, form: str = "yyyy年MM月dd日") -> Column:
    """``a/b`` as so many parts of ``b``, valid ``y/m/d`` as a date in Kanji digits."""

    def change(run: Column) -> Column:
        p = F.split(run, "[/／]")
        size = F.size(p)
        kanji = lambda c: F.translate(c, FULL_DIGITS, KANJI)
        ascii_ = lambda c: F.translate(c, FULL_DIGITS + KANJI, DIGITS + DIGITS)
        day = F.try_to_timestamp(F.concat_ws("-", *(ascii_(F.get(p, k)) for k in range(3))), F.lit("y-M-d"))
        out = run
        if dates:
            out = F.when((size == 3) & day.isNotNull(), F.translate(F.date_format(day, form), DIGITS, KANJI)).otherwise(out)
        if fractions:
            out = F.when((size == 2) & (F.get(p, 0) != "") & (F.get(p, 1) != ""), F.concat(kanji(F.get(p, 1)), F.lit("分の"), kanji(F.get(p, 0)))).otherwise(out)
        return out

    return _each_run(text, "0-9０-９" + KANJI + "十百千万億兆京垓/／", change)


def digits_near_letters(text: Column) -> Column:
    """Kanji digits beside full-width letters, or before signs of measure, as full-width digits."""
    return _near_letters(text, KANJI + "・～", lambda p: F.translate(p, KANJI, FULL_DIGITS))


def space_after_marks(text: Column) -> Column:
    """A full space after exclamation and question marks, but before closing brackets and signs."""
    text = F.regexp_replace(text, "(?<=[!?！？])[ 、。]", "　")
    return F.regexp_replace(text, f"(?<=[!?！？])(?=[^!?！？{AFTER_MARK}])", "　")


def ellipses(text: Column) -> Column:
    """Three or more dots or stops as an even number of ellipses, but beside a dash."""
    for dot in "・。、．":
        text = _by_steps(text, f"(?<![{dot}―])(?={dot}{{3,}}(?![{dot}―]))", f"{dot}{{1,6}}", "……")
    return F.replace(F.replace(text, F.lit("。。"), F.lit("。")), F.lit("、、"), F.lit("、"))


def long_marks_to_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "ー(?=ー)|(?<=ー)ー", "―")


def voiced_marks(text: Column) -> Column:
    return F.regexp_replace(text, "([ぁ-んァ-ヶι])[゛ﾞ]", "［＃濁点］$1［＃濁点終わり］")


def kana_two(text: Column) -> Column:
    """The Katakana that looks like the numeral two, where no Katakana is near."""
    return F.regexp_replace(text, "([^ァ-ヶー]{2})ニ([^ァ-ヶー]{2})", "$1二$2")


def joined_lines(text: Column) -> Column:
    """Lines that end in a comma with the next one, if that begins with ordinary text."""
    return F.regexp_replace(text, "([^、])、\\n　([^「『(（【<＜〈《≪・■…‥―　１-９一-九])", "$1、$2")


def bracket_indents(text: Column, half: bool = True) -> Column:
    return F.regexp_replace(text, f"(?m)^[ 　\\t]*([{OPENED}]|※［＃始め二重山括弧］)", ("［＃二分アキ］" if half else "") + "$1")


def lacks_indents(text: Column) -> Column:
    """Whether over half of the lines of plain text begin without a space."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"^[^{NO_INDENT}]"))
    return F.coalesce(F.try_divide(F.size(F.filter(lines, lambda x: ~x.rlike("^[ 　]"))), F.size(lines)) > 0.5, F.lit(False))


def indented(text: Column, always: bool = False) -> Column:
    """Dashes indented; all other lines of plain text, too, where most of them are not."""
    dashed = F.regexp_replace(text, "(?m)^[ 　\\t]*(――)", "　$1")
    plain = F.regexp_replace(dashed, f"(?m)^(?:[ 　]|(?=[^{NO_INDENT.replace('・', '')}\\n])(?!・(?!・)))", "　")
    return F.when(F.lit(always) | lacks_indents(dashed), plain).otherwise(dashed)


#: Stands for the indent of such a line until other lines are indented.
_DEEP = "［＃深］"


def chapter_lines(text: Column, hide: bool = False) -> Column:
    """Lines that are a number alone, perhaps between dashes, deeply indented with blank lines around; ``hide``: until :func:`deep_lines`."""
    line = f"^[ 　\\t]*([－―<＜〈\\-]*)([0-9０-９{KANJI}]{{1,3}})([－―>＞〉\\-]*)$"
    lines = F.split(text, "\n")

    def is_one(x: Column) -> Column:
        return x.rlike(line)

    def change(x: Column, before: Column, after: Column) -> Column:
        dash = F.regexp_extract(x, line, 1).rlike("^[―－\\-]")
        top, bottom = F.when(dash, "― ").otherwise(F.regexp_extract(x, line, 1)), F.when(dash, " ―").otherwise(F.regexp_extract(x, line, 3))
        number = full_width_digits(F.translate(F.regexp_extract(x, line, 2), FULL_DIGITS, DIGITS))
        number = hidden(number) if hide else number
        blank = lambda c: c.isNull() | c.rlike("^[ 　\\t]*$")
        return F.when(is_one(x), F.concat(F.when(blank(before) | is_one(before), "").otherwise("\n"), F.lit(_DEEP if hide else "　　　"), F.translate(top, "<>", "〈〉"), number, F.translate(bottom, "<>", "〈〉"), F.when(blank(after), "").otherwise("\n"))).otherwise(x)

    return F.array_join(_with_neighbours(lines, change), "\n")


def deep_lines(text: Column) -> Column:
    return F.replace(text, F.lit(_DEEP), F.lit("　　　"))


def border_lines(text: Column) -> Column:
    """Blank lines around lines of signs, which are indented by four."""
    lines = F.split(text, "\n")
    blank = lambda c: c.isNull() | c.rlike("^[ 　\\t]*$")
    border = lambda c: c.rlike(f"^[ 　\\t]*[{BORDERS}]+[ 　\\t{BORDERS}]*$")
    change = lambda x, before, after: F.when(border(x), F.concat(F.when(blank(before) | border(before), "").otherwise("\n"), F.lit("　　　　"), F.regexp_replace(x, "^[ 　\\t]*", ""), F.when(blank(after), "").otherwise("\n"))).otherwise(x)
    return F.array_join(_with_neighbours(lines, change), "\n")


def page_breaks(text: Column, lines: int = 10) -> Column:
    """So many blank lines together become a page break."""
    return F.regexp_replace(text, f"(?m)(?:^\\n){{{lines},}}", "［＃改頁］\n")


def packed_blanks(text: Column) -> Column:
    """Single blank lines go, of several together one stays less."""
    return F.regexp_replace(F.regexp_replace(text, "\\n\\n", "\n"), "(?m)(^\\n){3}", "\n\n")


_BASE, _KANA = "一-龠Ａ-Ｚａ-ｚA-Za-z", "ぁ-んァ-ヶーゝゞ・"


def emphasised(text: Column, brackets: bool = False) -> Column:
    """Dots as reading of a base become emphasis dots; with ``brackets`` middle dots in round ones, too."""
    for reading in ("≪[・、]+≫", *(["（・{1,20}）"] if brackets else [])):
        text = F.regexp_replace(text, f"｜([^｜≪≫（）\\n]+){reading}", "［＃傍点］$1［＃傍点終わり］")
        text = F.regexp_replace(text, f"([{_BASE}][{_BASE}　]*+){reading}", "［＃傍点］$1［＃傍点終わり］")
    return text


def ruby(text: Column, brackets: bool = True, large: bool = False) -> Column:
    """Readings: of what a bar marks, else in kana of the letters before; dots are emphasis.

    A reading may have one space inside: if the base has one as well, its parts are read apart.  One that begins with a space, or
    ends in two, is none.  A bar right before the bracket stands for the bracket itself.  Round brackets hold readings of
    up to 20 kana only.
    """
    text = emphasised(text, brackets)
    part, kana = f"(?<![{_BASE}{_MARK}])([{_BASE}]++)", f"[{_KANA}]+"
    for opening, closing, marked in (("≪", "≫", "[^≪≫\\n]+?"), *([("（", "）", f"[{_KANA} 　]{{1,20}}")] if brackets else [])):
        short = f"(?=[^{closing}]{{1,20}}{closing})"
        text = F.regexp_replace(text, f"｜([^｜≪≫（）《》\\n]+){opening}(?! )({marked})(?<!  ){closing}", f"{_MARK}$1《$2》")
        text = F.regexp_replace(text, f"{part}([ 　])([{_BASE}]++){opening}{short}({kana})[ 　]({kana}){closing}", f"{_MARK}$1《$4》$2{_MARK}$3《$5》")
        text = F.regexp_replace(text, f"{part}{opening}{short}({kana}[ 　]?[{_KANA}]*){closing}", f"{_MARK}$1《$2》")
    text = F.regexp_replace(text, "｜([≪（])", "$1")
    if large:
        text = F.array_join(F.transform(F.split(text, "(?=《)|(?<=》)"), lambda p: F.when(p.startswith("《"), F.translate(p, SMALL_KANA, LARGE_KANA)).otherwise(p)), "")
    return F.translate(F.replace(text, F.lit("｜"), F.lit("※［＃縦線］")), _MARK, "｜")


def headings(text: Column) -> Column:
    """The line after a page break as a middle heading."""
    return F.regexp_replace(text, "［＃改ページ］\\n[　\\s]*(?:［＃半字下げ］)?([^\\n]+?)[　 ]*\\n", "［＃改ページ］\n\n［＃３字下げ］［＃中見出し］$1［＃中見出し終わり］\n")


def spaced_headings(text: Column) -> Column:
    """The line after a page break as a middle heading with two blank lines behind it; one behind a foreword is set before that."""
    title = "[　\\s]*(?:［＃半字下げ］)?([^\\n]+?)[　 ]*\\n"
    plain = F.regexp_replace(text, f"［＃改ページ］\\n(?!［＃ここから前書き］){title}\\n{{0,2}}", "［＃改ページ］\n\n［＃３字下げ］［＃中見出し］$1［＃中見出し終わり］\n\n\n")
    fore = "(?s)(［＃改ページ］\\n)(［＃ここから前書き］.+?［＃ここで前書き終わり］\\n)" + title
    return F.regexp_replace(plain, fore + "(\\n?)", "$1［＃３字下げ］［＃中見出し］$3［＃中見出し終わり］$2\n")


def author_comments(text: Column, erase: bool = False) -> Column:
    """Lines of 44 asterisks end a foreword, lines of 48 begin an afterword; each is marked, or goes."""
    fore = "(?ms)(\\A|［＃改ページ］\\n)(.*?)^[*＊]{44}$\\n"
    after = "(?ms)^[*＊]{48}$\\n(.*?)(?=［＃改ページ］|\\z)"
    if erase:
        return F.regexp_replace(F.regexp_replace(text, fore, "$1"), after, "")
    text = F.regexp_replace(text, fore, "$1［＃ここから前書き］\n$2［＃ここで前書き終わり］\n")
    return F.regexp_replace(text, after, "［＃ここから後書き］\n$1\n［＃ここで後書き終わり］\n")


def without_comment_blocks(text: Column) -> Column:
    """Nothing between two lines of 50 dashes or more."""
    return F.regexp_replace(text, "(?ms)^-{50,}\\n.*?^-{50,}\\n", "")


def site_tags(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("【改ページ】"), F.lit("")), "(?i)<[KP]BR>", "\n")


def linked(text: Column) -> Column:
    """Addresses as links."""
    return F.regexp_replace(text, "https?://[A-Za-z0-9\\-._~:/?#@!$&*+,;=%]+", '<a href="$0">$0</a>')


def hidden_links(text: Column) -> Column:
    """Addresses as links that later steps do not see; :func:`shown` ends it."""
    marked = F.regexp_replace(text, "https?://[A-Za-z0-9\\-._~:/?#@!$&*+,;=%]+", f'{_MARK}<a href="$0">$0</a>{_MARK}')
    return F.array_join(F.transform(F.split(marked, _MARK), lambda p, i: F.when(i % 2 == 1, F.translate(p, _ADDRESS, _PRIVATE_ADDRESS)).otherwise(p)), "")


def illustrations(text: Column) -> tuple[Column, Column]:
    """The notes of pictures in order, and the text without them."""
    note = "［＃挿絵（[^）\\n]*）入る］"
    return F.regexp_extract_all(text, F.lit(note), F.lit(0)), F.regexp_replace(text, note + "\\n?", "")


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal pairs one after the other."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def without_dust(text: Column) -> Column:
    return F.replace(text, F.lit("︎"), F.lit(""))


def bars(text: Column) -> Column:
    return F.replace(text, F.lit("｜"), F.lit("※［＃縦線］"))


def vertical(text: Column) -> Column:
    """Marks for vertical lines: full width, ellipses and dashes in pairs, a space after exclamations."""
    text = F.translate(text, "!?~", "！？～")
    text = F.regexp_replace(text, "…+|\\.{3,}|・{3,}", "……")
    text = F.regexp_replace(text, "[―—─]+", "――")
    return F.regexp_replace(text, "([！？])([^！？　」』）〉》】\\n])", "$1　$2")


def upright_runs(text: Column) -> Column:
    """One to three digits or letters alone stand upright."""
    return F.regexp_replace(text, "(?<![0-9A-Za-z])([0-9]{1,3}|[A-Za-z]{1,3})(?![0-9A-Za-z])", _tcy("$1"))


def heading_levels(text: Column) -> Column:
    """Sections of a text that begin at headings, as ``level, title, body, size``; level 0 is what stands before the first.

    ``size``: the characters of a section, its heading among them; a text that begins with a heading has no level 0.
    """
    mark = "［＃([大中小])見出し］"
    parts = F.split(text, "(?=［＃[大中小]見出し］)")
    level = lambda p: F.coalesce(F.nullif(F.instr(F.lit("大中小"), F.regexp_extract(p, "^" + mark, 1)), F.lit(0)), F.lit(0))
    one = lambda p: F.struct(F.when(p.rlike("^" + mark), level(p)).otherwise(0).alias("level"), F.regexp_extract(p, f"(?s)^{mark}(.*?)［＃", 2).alias("title"), F.regexp_replace(p, f"(?s)^{mark}.*?見出し終わり］\\n?", "").alias("body"), F.length(p).alias("size"))
    return F.transform(F.filter(parts, lambda p: p != ""), one)


def character_class(char: Column) -> Column:
    """What kind of character it is: kanji, hiragana, katakana, full or half letters and digits, marks, other."""
    kinds = [("kanji", "[一-龠々〇]"), ("hiragana", "[ぁ-んゝゞ]"), ("katakana", "[ァ-ヶーヽヾ]"), ("full letter", "[Ａ-Ｚａ-ｚ]"), ("full digit", "[０-９]"), ("letter", "[A-Za-z]"), ("digit", "[0-9]"), ("space", "[\\s　]"), ("bracket", "[「」『』（）()［］〈〉《》【】]"), ("mark", "[、。！？…‥・―ー〜]")]
    return reduce(lambda rest, k: F.when(char.rlike(f"^{k[1]}$"), k[0]).otherwise(rest), reversed(kinds), F.lit("other"))


def reading_base(text: Column) -> Column:
    """The last run of characters of one kind, which a reading behind the text belongs to."""
    kinds = ("一-龠々〇", "ぁ-んゝゞ", "ァ-ヶー", "Ａ-Ｚａ-ｚ", "０-９", "A-Za-z", "0-9")
    return F.regexp_extract(text, "(" + "|".join(f"[{k}]+" for k in kinds) + ")$", 1)


def external_characters(text: Column) -> Column:
    """Notes of characters outside the set: the character where its code is given, else its description."""
    pieces = F.split(text, "(?=※［＃)|(?<=］)")
    code = F.regexp_extract
    one = lambda p: F.when(p.rlike("^※［＃[^］]*U\\+[0-9A-Fa-f]{4,5}[^］]*］$"), F.decode(F.unhex(F.lpad(code(p, "U\\+([0-9A-Fa-f]{4,5})", 1), 8, "0")), "UTF-32")).when(p.rlike("^※［＃[^］]*］$"), F.concat(F.lit("※（"), code(p, "^※［＃「?([^」、］]*)", 1), F.lit("）"))).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def without_ruby_tags(html: Column) -> Column:
    return F.regexp_replace(html, "(?i)</?(?:ruby|rb|rt|rp|rtc)\\b[^>]*>", "")


def lines_to_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\\r?\\n", "<br />")


def single_blanks(text: Column) -> Column:
    """Lines trimmed, one blank line where there were several, none at the ends."""
    text = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^[\\s　]+|[\\s　]+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\n+|\\n+$", "")


def joined_brackets(text: Column) -> Column:
    """Lines within outermost brackets joined, but for those with very many lines or characters."""
    for opening, closing in ("「」", "『』"):
        text = brackets.joined_inside(text, opening, closing, BRACKET_LINES, BRACKET_LENGTH)
    return text


def bracket_counts(text: Column, opening: str = "「", closing: str = "」") -> Column:
    """Outermost pairs, those of :data:`BRACKET_LINES` line ends or more, and the most and all line ends in them."""
    lines = brackets.line_ends_inside(text, opening, closing)
    return F.struct(F.size(lines).alias("brackets"), F.size(F.filter(lines, lambda n: n >= BRACKET_LINES)).alias("long"), F.coalesce(F.array_max(lines), F.lit(0)).alias("most"), F.aggregate(lines, F.lit(0), lambda a, n: a + n).alias("all"))


def unclosed(text: Column, opening: str = "「", closing: str = "」") -> Column:
    """What is left of the brackets when all pairs are gone: how many of each kind."""
    found = brackets.bracket_scan(text, opening, closing)
    return F.struct(F.size(found["unclosed"]).alias("open"), F.size(found["unopened"]).alias("lost"))


def converted(df: DataFrame, column: str, kind: str = "body", settings: dict | None = None, pairs: list[tuple[str, str]] = (), before=None, after=None) -> DataFrame:
    """``df`` with the texts of a column converted, one step after the other; ``kind``: ``body``, ``subtitle``, ``chapter``, ``story``, ``introduction`` or ``postscript``.

    ``settings`` (all off or at their usual value where missing): ``join_brackets, join_lines, kanji,
    units, zeros, fractions, dates, dakuten, dashes, half_indent, indent, ruby, large_kana, page_break,
    keep_words, full_letters, pack, comments, headings, force_indent, separators, char_separators``.  ``pairs`` are replaced at the end; ``before`` and ``after`` are functions of
    a Column and the kind, applied around the steps.

    Steps are those of :mod:`quire.functions.whole`, one pass for all that follow each other.
    """
    usual = {"join_brackets": True, "join_lines": True, "kanji": True, "units": True, "zeros": 3, "half_indent": True, "indent": True, "ruby": True, "ellipses": True, "pack": True, "comments": True, "headings": True}
    s = usual | (settings or {})
    body = kind in ("body", "textfile")
    titles = kind in ("subtitle", "chapter")
    # steps over whole texts, and those of Columns where there is no other
    steps: list[tuple[bool, Callable]] = []

    def text(f: Callable, *more) -> None:
        steps.append((True, (lambda t: f(t, *more)) if more else f))

    def expression(f: Callable) -> None:
        steps.append((False, f))

    text(W.trimmed_lines)
    if body and s.get("page_break"):
        text(W.page_breaks, s["page_break"])
    if s.get("pack") and kind != "story":
        text(W.packed_blanks)
    if before:
        expression(lambda t: before(t, kind))
    text(W.full_width_kana)
    if s.get("join_brackets"):
        text(W.joined_brackets)
    if s.get("join_lines"):
        text(W.joined_lines)
    if kind == "textfile":
        expression(without_comment_blocks)
    for f in (W.hidden_links, W.site_tags, W.roman_numerals):
        text(f)
    if s.get("full_letters"):
        text(W.all_letters)
    else:
        text(W.letters, bool(s.get("keep_words")))
    if body:
        text(W.chapter_lines)
    text(W.decimals)
    if s.get("kanji") and not titles and kind != "story":
        text(W.numbers, s["zeros"] if s.get("units") else None)
    else:
        text(W.full_width_digits, kind == "subtitle")
    for f in (W.space_after_marks, W.notes_hidden, W.full_width_symbols, W.upright_marks, W.even_ellipses, W.head_spaces):
        text(f)
    if s.get("fractions") or s.get("dates"):
        expression(lambda t: fractions_and_dates(t, bool(s.get("fractions")), bool(s.get("dates"))))
    for name, f in (("kana_two", W.kana_two), ("dakuten", W.voiced_marks), ("dashes", W.long_marks_to_dashes)):
        if s.get(name):
            text(f)
    if not titles:
        text(W.trimmed_lines)
        text(W.border_lines)
    if kind == "textfile" and s.get("comments"):
        expression(author_comments)
    if kind == "textfile" and s.get("headings"):
        expression(spaced_headings)
    text(W.shown)
    text(W.notes_shown)
    if body:
        text(W.bracket_indents, bool(s.get("half_indent")))
        if s.get("indent"):
            text(W.indented, bool(s.get("force_indent")))
        text(W.deep_lines)
    if s.get("ruby") and not titles:
        text(W.ruby, bool(s.get("large_kana")))
    if s.get("ellipses") and not titles:
        text(W.ellipses)
    text(W.angle_notes)
    text(W.without_dust)
    if after:
        expression(lambda t: after(t, kind))
    text(W.replaced, list(pairs))
    by = "word" if s.get("separators") else "character" if s.get("char_separators") else None
    out = df
    for whole, together in groupby(steps, lambda x: x[0]):
        fs = [f for _, f in together]
        out = W.applied(out, column, fs) if whole else reduce(lambda d, f: d.withColumn(column, f(F.col(column))), fs, out)
    return separated(out, column, by) if body and by else out
