"""Rules that find chapters, pages and contents in stored pages; rules are data, results are rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Elements without an end, and parameters of addresses that only track.
EMPTY_ELEMENTS = frozenset("area base br col embed hr img input link meta source track wbr".split())
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")
FOUND = "position int, index string, href string, subtitle string, chapter string, updated string"


@dataclass(frozen=True)
class RegexRule:
    """Each match is a row; values are templates of ``{1}``, ``{2}`` and so on."""

    pattern: str
    href: str = "{1}"
    subtitle: str = "{2}"
    index: str = ""
    chapter: str = ""
    updated: str = ""


@dataclass(frozen=True)
class SelectorRule:
    """Elements are rows; ``chapter_selector`` names headings that hold for the rows after them.

    Values: a selector within the row (nothing: the row itself), with ``::attr(name)`` or its text.
    """

    selector: str
    href: str = "::attr(href)"
    subtitle: str = ""
    index: str | None = None
    updated: str | None = None
    chapter_selector: str | None = None
    href_pattern: str | None = None


@dataclass(frozen=True)
class JsonRule:
    """A list in a script's or the page's JSON: its path, and the keys of its values."""

    path: str
    href: str = "href"
    subtitle: str = "title"
    script: str | None = None


def filled(template: str, match: Column, pattern: str) -> Column:
    """The template with the groups of a match."""
    parts = [F.regexp_extract(match, pattern, int(p[1:-1])) if re.fullmatch(r"\{\d+\}", p) else F.lit(p) for p in re.split(r"(\{\d+\})", template) if p]
    return F.concat(*parts) if parts else F.lit(None).cast("string")


def regex_rows(pages: DataFrame, key: str, rule: RegexRule) -> DataFrame:
    """``key`` and :data:`FOUND` for each match of the page's ``html``; of rows with one address the first, none without address or title."""
    m = F.col("match")
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(rule.pattern), F.lit(0))).alias("n", "match"))
    value = lambda t: filled(t, m, rule.pattern)
    rows = found.select(key, "n", T.decode_entities(value(rule.href)).alias("href"), F.trim(T.json_unescaped(value(rule.subtitle))).alias("subtitle"), value(rule.index).alias("own"), value(rule.chapter).alias("chapter"), value(rule.updated).alias("updated"))
    first = rows.filter("href <> '' AND subtitle <> ''").groupBy(key, "href").agg(F.min(F.struct("n", "own", "subtitle", "chapter", "updated")).alias("r")).select(key, "href", "r.*")
    return _numbered(first, key)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy(key).orderBy("n"))
    index = F.coalesce(F.nullif("own", F.lit("")), position.cast("string"))
    return rows.select(key, position.alias("position"), index.alias("index"), "href", "subtitle", "chapter", "updated")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    children: list = field(default_factory=list)
    #: The element before it among its parent's, its place there from 1, and how many elements it has itself.
    before: Element | None = None
    place: int = 1
    elements: int = 0
    last: Element | None = None

    def add(self, e: Element) -> None:
        self.elements += 1
        e.before, e.place, self.last = self.last, self.elements, e
        self.children.append(e)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def below(self) -> Iterator[Element]:
        waiting = [c for c in reversed(self.children) if not isinstance(c, str)]
        while waiting:
            e = waiting.pop()
            yield e
            waiting += [c for c in reversed(e.children) if not isinstance(c, str)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.add(e)
        if tag not in EMPTY_ELEMENTS:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.add(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


#: One part of a compound selector: a name, ``#id``, ``.class``, ``[attribute]`` or ``:pseudo(argument)``.
_PART = re.compile(r"""(?P<name>\*|[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[\s*(?P<key>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]*))\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<argument>(?:[^()]|\([^()]*\))*)\))?""")
#: A compound, which brackets and parentheses hold together, or what stands between two.
_STEP = re.compile(r"""\s*([>+~,])\s*|(\s+)|((?:[^\s>+~,\[(]|\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\))+)""")
_COMPARED = {
    "=": lambda have, want: have == want,
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def _nth(argument: str, place: int) -> bool:
    """Whether a place is one of ``an+b``, ``odd`` or ``even``."""
    form = {"odd": "2n+1", "even": "2n"}.get(argument.strip().lower(), argument.replace(" ", "").lower())
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", form)
    if not m:
        raise ValueError(f"no places: {argument}")
    if m.group(3):
        return place == int(m.group(3))
    step = int(m.group(1) + "1") if m.group(1) in ("", "+", "-") else int(m.group(1))
    first = int(m.group(2) or 0)
    return place == first if step == 0 else (place - first) % step == 0 and (place - first) // step >= 0


_PSEUDO = {
    "first-child": lambda e, _: e.place == 1,
    "last-child": lambda e, _: e.place == e.parent.elements,
    "only-child": lambda e, _: e.parent.elements == 1,
    "nth-child": lambda e, x: _nth(x, e.place),
    "nth-last-child": lambda e, x: _nth(x, e.parent.elements - e.place + 1),
    "empty": lambda e, _: not e.children,
    "not": lambda e, x: not any(_holds(e, way, None) for way in _ways(x)),
    "is": lambda e, x: any(_holds(e, way, None) for way in _ways(x)),
}


@cache
def _ways(selector: str) -> list[list[tuple[str, str]]]:
    """For each selector of a list its compounds from left to right, each with how it follows the one before."""
    out: list[list[tuple[str, str]]] = [[]]
    how, end = " ", 0
    for m in _STEP.finditer(selector.strip()):
        if m.start() != end:
            break
        end = m.end()
        if m.group(1) and (how != " " or not out[-1]):
            raise ValueError(f"no selector: {selector}")
        if m.group(1) == ",":
            out.append([])
        elif m.group(3):
            out[-1].append((how, m.group(3)))
            how = " "
        elif m.group(1):
            how = m.group(1)
    if how != " " or end != len(selector.strip()) or not all(out):
        raise ValueError(f"no selector: {selector}")
    return out


@cache
def _parts(compound: str) -> list[dict[str, str | None]]:
    found = list(_PART.finditer(compound))
    if "".join(m.group() for m in found) != compound:
        raise ValueError(f"no selector: {compound}")
    return [m.groupdict() for m in found]


def _fits(e: Element, compound: str) -> bool:
    for p in _parts(compound):
        if p["pseudo"]:
            if p["pseudo"] not in _PSEUDO:
                raise ValueError(f"no selector: :{p['pseudo']}")
            if not _PSEUDO[p["pseudo"]](e, p["argument"] or ""):
                return False
        elif p["key"]:
            want = next((p[x] for x in "abc" if p[x] is not None), "")
            if p["key"] not in e.attributes or (p["how"] and not _COMPARED[p["how"]](e.attributes[p["key"]], want)):
                return False
        elif p["id"] is not None and e.attributes.get("id") != p["id"]:
            return False
        elif p["class"] is not None and p["class"] not in e.attributes.get("class", "").split():
            return False
        elif p["name"] not in (None, "*", e.tag):
            return False
    return True


def _holds(e: Element, way: list[tuple[str, str]], top: Element | None) -> bool:
    """Whether an element fits the last compound and what stands before it those to the left; ``top``: nothing above it counts."""
    how, compound = way[-1]
    if e.parent is None or not _fits(e, compound):
        return False
    rest = way[:-1]
    if not rest:
        return True
    at = e.before if how in "+~" else e.parent if e is not top else None
    while at is not None:
        if _holds(at, rest, top):
            return True
        if how in "+>":
            return False
        at = at.before if how == "~" else at.parent if at is not top else None
    return False


def selected(root: Element, selector: str) -> list[Element]:
    """Elements below ``root`` in order.

    Names, ``#id``, ``.class``, attributes with all comparisons, ``:not``, ``:is``, ``:nth-child`` and the like; a compound follows
    another as descendant, child (``>``), next (``+``) or later sibling (``~``); lists.  Others are an error.
    """
    return [e for e in root.below() if any(_holds(e, w, root) for w in _ways(selector))]


def value_of(e: Element, expression: str, blanks: bool = False) -> str:
    """The text or the attribute that an expression of a rule names; nothing if there is no such element; ``blanks``: those around it stay."""
    selector, _, attribute = expression.partition("::attr(")
    if selector.strip():
        inner = selected(e, selector.strip())
        if not inner:
            return ""
        e = inner[0]
    value = e.attributes.get(attribute[:-1], "") if attribute else e.text()
    return value if blanks else value.strip()


def select_page(html: str, rule: SelectorRule) -> list[tuple]:
    out: list[tuple] = []
    seen, heading = set(), None
    names = rule.selector + (f", {rule.chapter_selector}" if rule.chapter_selector else "")
    root = parsed(html)
    headings = {id(e) for e in selected(root, rule.chapter_selector)} if rule.chapter_selector else set()
    for e in selected(root, names):
        if id(e) in headings:
            heading = e.text().strip()
            continue
        href, subtitle = value_of(e, rule.href), value_of(e, rule.subtitle)
        if rule.href_pattern and not re.search(rule.href_pattern, href):
            continue
        index = (value_of(e, rule.index) if rule.index else "") or str(len(out) + 1)
        if href and subtitle and (index, href) not in seen:
            seen.add((index, href))
            out.append((len(out) + 1, index, href, subtitle, heading, value_of(e, rule.updated) if rule.updated else None))
    return out


def selector_rows(pages: DataFrame, key: str, rule: SelectorRule) -> DataFrame:
    """``key`` and :data:`FOUND` for each element that the rule selects in ``html``; pages are read one by one, in batches."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *r) for k, h in zip(frame[key], frame["html"]) for r in select_page(h or "", rule)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pages.select(key, "html").mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, {FOUND}")


def selector_value(html: Column, expression: str) -> Column:
    """The first value of a selector expression in each page."""

    @F.pandas_udf("string")
    def one(column: pd.Series) -> pd.Series:
        return column.map(lambda h: value_of(parsed(h or ""), expression) or None)

    return one(html)


#: Stands for the sign that entities begin with, where they must not be decoded; no stored text can hold it.
_ENTITY = "\ud800"


def written_value(html: Column, expression: str) -> Column:
    """The first value of a selector expression in each page as it is written there: entities and blanks around it stay."""

    @F.pandas_udf("string")
    def one(column: pd.Series) -> pd.Series:
        return column.map(lambda h: value_of(parsed((h or "").replace("&", _ENTITY)), expression, True).replace(_ENTITY, "&") or None)

    return one(html)


def json_rows(pages: DataFrame, key: str, rule: JsonRule) -> DataFrame:
    """``key`` and :data:`FOUND` for each item of a JSON list in the page or in a script of it."""
    body = F.regexp_extract("html", rule.script, 1) if rule.script else F.col("html")
    items = F.from_json(F.get_json_object(body, "$." + rule.path), "array<map<string,string>>")
    found = pages.select(key, F.posexplode(items).alias("n", "item"))
    rows = found.select(key, "n", F.col("item")[rule.href].alias("href"), F.col("item")[rule.subtitle].alias("subtitle"), F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("updated"))
    first = rows.filter("href <> '' AND subtitle <> ''").groupBy(key, "href").agg(F.min(F.struct("n", "own", "subtitle", "chapter", "updated")).alias("r")).select(key, "href", "r.*")
    return _numbered(first, key)


def by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """For each page the rows of the first source that has any."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources)])
    best = ranked.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [key, "_rank"], "left_semi").drop("_rank")


#: Pages of a list of contents that are followed.
MOST_PAGES = 1000


def _last_page(pattern: str) -> Column:
    """The largest number that the pattern's group finds; one of over 18 digits counts as the largest there is."""
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    numbers = F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda x: F.when(F.length(digits(x)) > 18, F.lit(2**62)).otherwise(digits(x).try_cast("bigint")))
    return F.coalesce(F.array_max(numbers), F.lit(1))


def page_range(pattern: str, template: str, most: int = MOST_PAGES) -> Column:
    """Addresses of pages 2 to the largest number that the pattern's group finds, or to ``most``; ``{page}`` in the template."""
    last = F.least(_last_page(pattern), F.lit(most)).cast("int")
    pages = F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(pages, lambda n: F.replace(F.lit(template), F.lit("{page}"), n.cast("string")))


def too_many_pages(pattern: str, most: int = MOST_PAGES) -> Column:
    """Whether a page names more pages than :func:`page_range` gives."""
    return _last_page(pattern) > most


def split_title(text: Column, delimiter: str, author_pattern: str) -> tuple[Column, Column]:
    """Title and author: what stands before and after the first delimiter; else the author that the pattern finds."""
    at = F.instr(text, F.lit(delimiter))
    title = F.when(at > 0, F.trim(F.substr(text, F.lit(1), at - 1))).otherwise(F.trim(text))
    after = F.when(at > 0, F.trim(F.substr(text, at + len(delimiter)))).otherwise("")
    return title, F.coalesce(F.nullif(after, F.lit("")), F.nullif(F.regexp_extract(text, author_pattern, 1), F.lit("")))


def site_of(url: Column, sites: dict[str, list[str]]) -> Column:
    """The site whose domain the address's host is or lies below."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in domains)), k) for k, domains in sites.items()))


def plain_url(url: Column) -> Column:
    """An address with its host in small letters and without fragments and parameters that only track."""
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    rest = F.regexp_replace(F.substr(url, F.length(host) + 1), "#.*$", "")
    for name in TRACKING:
        rest = F.regexp_replace(rest, rf"([?&]){name}=[^&]*(&|$)", "$1")
    return F.concat(F.lower(host), F.regexp_replace(rest, "[?&]+$", ""))


def merged_settings(base: dict, over: dict) -> dict:
    """Nested settings, the second's values before the first's."""
    return base | {k: merged_settings(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def modern_template(old: str) -> str:
    r"""A template with ``\k<name>`` or ``\\k<name>`` as one with ``{name}``."""
    return re.sub(r"\\+k<(\w+)>", r"{\1}", old)


def broken_rules(history: DataFrame, now: DataFrame) -> DataFrame:
    """``site, selector``: the last selector of each site that had rows and has none now; ``history``: ``site, selector, at, rows``."""
    last = history.filter("rows > 0").groupBy("site").agg(F.max_by("selector", "at").alias("selector"))
    return last.join(now.filter("rows > 0").select("site", "selector"), ["site", "selector"], "left_anti")


def script_state(pages: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """``key`` and the named values of ``(function(a,b){return {name:a}})(1,2)`` in a page's script, as their types."""
    found = F.regexp_extract("html", r"(?s)\(function\(([\w,$ ]*)\)\s*\{\s*return\s*(\{.*?\})\s*\}\)\((.*?)\)\s*</script>", 0)
    part = lambda k: F.regexp_extract(found, r"(?s)\(function\(([\w,$ ]*)\)\s*\{\s*return\s*(\{.*?\})\s*\}\)\((.*?)\)\s*</script>", k)
    arguments = F.split(F.trim(part(1)), r"\s*,\s*")
    values = F.from_json(F.concat(F.lit("["), part(3), F.lit("]")), "array<string>")
    rows = pages.select(key, arguments.alias("arguments"), values.alias("values"), part(2).alias("body"))

    def value(name: str) -> Column:
        """What stands in the place of the name's argument; of arguments with one name the last counts."""
        argument = F.nullif(F.regexp_extract("body", rf"\b{name}\s*:\s*([\w$]+)", 1), F.lit(""))
        from_end = F.array_position(F.reverse("arguments"), argument)
        return F.when(from_end > 0, F.get("values", (F.size("arguments") - from_end).cast("int")))

    return rows.select(key, *(value(n).try_cast(kind).alias(n) for n, kind in names.items()))
