"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities in the order they are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")]
#: Characters that file names cannot have, and their full-width forms.
UNSAFE, SAFE = '\\/:*?"<>|.`', "￥／：＊？”〈〉｜．｀"
HALF, FULL, KANJI = "0123456789", "０１２３４５６７８９", "〇一二三四五六七八九"


def decode_entities(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def html_to_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; entities decoded, white space collapsed."""
    gone = r"<(script|style)\b[^>]*>[\s\S]*?</\1\s*>|<!--[\s\S]*?-->|<[^>]*>"
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, "(?i)" + gone, " ")), "[ \\t\\r\\n\\f]+", " "))


def without_spaces_around(text: Column) -> Column:
    """Text without spaces of any width at its ends; tabs and line ends stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")


def file_name(title: Column, most: int = 80) -> Column:
    return F.substring(F.translate(F.regexp_replace(title, "[\\x00-\\x1f]", ""), UNSAFE, SAFE), 1, most)


def masked(text: Column) -> Column:
    """All characters but digits, spaces and some punctuation hidden."""
    return F.regexp_replace(text, "[^0-9 \\n.,!?]", "●")


def full_width_digits(text: Column) -> Column:
    return F.translate(text, HALF, FULL)


def kanji_digits(text: Column) -> Column:
    return F.translate(F.translate(text, FULL, HALF), HALF, KANJI)


def integer_with_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def indent_ratio(text: Column) -> Column:
    """Share of lines with text that do not begin with a space; null without such lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    return F.try_divide(F.size(F.filter(lines, lambda x: ~x.rlike("^[ 　\\t]"))), F.size(lines))


def work_id(url: Column) -> Column:
    """Host without ``www.``, a colon, and the path without its last slash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.concat(host, F.lit(":"), path)


def reverse_time(ts: Column) -> Column:
    """A short name that sorts backwards in time."""
    return F.lpad(F.lower(F.conv(F.floor((F.lit(2091149000) - F.unix_timestamp(ts)) / 600).cast("string"), 10, 36)), 4, "0")


def output_name(author: Column, title: Column, most: int = 80) -> Column:
    """``[author] title.txt`` as a file name; the ending stays where the name is cut."""
    return F.concat(F.substring(F.concat(F.lit("["), file_name(author), F.lit("] "), file_name(title, 10**6)), 1, most), F.lit(".txt"))


def decorated_title(title: Column, form: str, values: dict[str, Column]) -> Column:
    """The form with ``$t`` for the title and ``$name`` for other values, longer names first."""
    out = F.lit(form)
    for name in sorted(values, key=len, reverse=True):
        out = F.replace(out, F.lit("$" + name), values[name])
    return F.replace(out, F.lit("$t"), title)


def xhtml(text: Column) -> Column:
    """Line ends, breaks, rules and paragraphs in one form, readings as ruby elements."""
    text = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "(?i)<br\\s*/?>", "<br />")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)<hr\\s*/?>", "<hr />"), "(?i)<(/?)p\\b[^>]*>", "<$1p>")
    return F.regexp_replace(text, "｜([^《》｜\\n]+)《([^》\\n]+)》", "<ruby>$1<rt>$2</rt></ruby>")


def reader_text(html: Column) -> Column:
    """Plain text with readings in brackets, a line for each paragraph, one blank line at most."""
    text = F.regexp_replace(html, "(?is)<ruby[^>]*>(?:<rb>)?([^<]*)(?:</rb>)?(?:<rp>[^<]*</rp>)?<rt[^>]*>([^<]*)</rt>(?:<rp>[^<]*</rp>)?</ruby>", "$1($2)")
    text = F.regexp_replace(text, "(?i)<br\\s*/?>|</p>", "\n")
    text = decode_entities(F.regexp_replace(text, "(?s)<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def html_to_aozora(html: Column) -> Column:
    """Marked-up text: breaks, paragraphs, readings, bold and pictures as notes; all other tags go."""
    text = F.regexp_replace(F.regexp_replace(html, "\\r?\\n", ""), "(?i)<br\\s*/?>|</p>", "\n")
    text = F.regexp_replace(text, "(?is)<ruby[^>]*>(?:<rb>)?([^<]*)(?:</rb>)?(?:<rp>[^<]*</rp>)?<rt[^>]*>([^<]*)</rt>(?:<rp>[^<]*</rp>)?</ruby>", "｜$1《$2》")
    for tag, name in (("b", "太字"), ("i", "斜体"), ("s", "取消線")):
        text = F.regexp_replace(F.regexp_replace(text, f"(?i)<{tag}>", f"［＃{name}］"), f"(?i)</{tag}>", f"［＃{name}終わり］")
    text = F.regexp_replace(text, "(?i)<img\\b[^>]*?src=\"([^\"]*)\"[^>]*>", "［＃挿絵（$1）入る］")
    return decode_entities(F.regexp_replace(text, "(?s)<[^>]*>", ""))


def json_unescaped(text: Column) -> Column:
    """A JSON string's inside decoded; text that is none stays."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v"), text)


def cleaned_query(raw: Column) -> Column:
    """Words of a search: percent signs decoded, ``site:`` words left out, spaces collapsed."""
    plain = F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "(?i)(^|\\s)site:\\S*", " "), "\\s+", " "))


def resolved_url(href: Column, base: Column) -> Column:
    """An address as seen from a page: whole ones stay, others start at the scheme, the host or the page's folder."""
    origin, scheme = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1), F.regexp_extract(base, "^([a-z]+):", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "/[^/]*$", "/")
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href)).otherwise(F.concat(folder, href))
