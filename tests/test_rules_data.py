import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import brackets
from quire.operators import queue, rulesets, templates


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


# patterns and templates


def test_first_pattern_sets_all_its_groups(spark):
    rule = {"a": [r"x(?<one>\d)(?<two>\w)?", r"y(?<one>\d)"], "b": [r"z(?<two>\d)"], "c": ["(?<three>never)"]}
    for text, want in (("y7 x1", ("1", "", None)), ("y7 x1 z9", ("1", "9", None)), ("y7", ("7", None, None)), ("x1q", ("1", "q", None)), ("", (None, None, None))):
        df = templates.matched(spark.createDataFrame([(text,)], "t string"), F.col("t"), rule, ["a", "b", "c"])
        assert tuple(df.select("one", "two", "three").first()) == want
    assert templates.group_numbers(r"(a)(?<=b)(?<n>c(d))(?<m>e)") == {"n": 2, "m": 4}


def test_values_refer_to_values(spark):
    values = {"host": F.lit("h.example"), "top": F.lit(r"https://\\k<host>"), "list": F.lit(r"\k<top>/l/\\k<id>"), "id": F.col("id"), "none": F.lit(None).cast("string"), "loop": F.lit(r"\k<loop>")}
    fill = lambda t: one(spark, templates.filled(F.lit(t), values), id="7")
    assert fill(r"<\\k<list>>") == "<https://h.example/l/7>"
    assert fill(r"\k<none> \k<other> \k<loop>") == r"\\k<none> \k<other> \k<loop>".replace(r"\\k<none>", r"\k<none>")
    assert fill("plain") == "plain"


def slow_consumed(text, patterns):
    compiled = [re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", p)) for p in patterns]
    names = sorted({n for c in compiled for n in c.groupindex})
    out = []
    while True:
        m = next((m for c in compiled if (m := c.search(text))), None)
        if not m:
            return out
        out.append(tuple(m.groupdict().get(n) or ("" if n in m.re.groupindex else None) for n in names))
        text = text[m.end() :]


def test_matches_are_taken_off_the_page(spark):
    r = random.Random(3)
    patterns = [r"<a(?<href>\d*)>(?<title>[^<]*)</a>", r"<b>(?<title>\w+)", r"<c(?<date>\d)>"]
    texts = ["".join(r.choice(["<a1>one</a>", "<a></a>", "<b>two", "<c3>", "x", "\n"]) for _ in range(r.randrange(14))) for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for x in templates.consumed(df, "k", F.col("t"), patterns).orderBy("k", "n").collect():
        got.setdefault(x.k, []).append((x.date, x.href, x.title))
        assert x.n == len(got[x.k])
    assert got == {k: w for k, t in enumerate(texts) if t and (w := slow_consumed(t, patterns))}
    with pytest.raises(ValueError, match="nothing"):
        templates.consumed(df, "k", F.col("t"), ["(?<n>a*)"])


def test_dates_from_the_stored_contents(spark):
    schema = "work int, n int, subdate string, subupdate string"
    page = spark.createDataFrame([(1, 1, "own", "u"), (1, 2, None, "u2"), (1, 3, None, "u3"), (1, 4, None, "u4"), (2, 1, None, None)], schema)
    old = spark.createDataFrame([(1, 1, "x", "y"), (1, 2, "first", "revised"), (1, 3, "first", None), (1, 4, None, "revised")], schema)
    got = {(r.work, r.n): r.subdate for r in templates.dated(page, old, ["work", "n"]).collect()}
    assert got == {(1, 1): "own", (1, 2): "revised", (1, 3): "first", (1, 4): "u4", (2, 1): None}


# rule sets


def merged(base, over):
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def flat(settings, above=""):
    out = {}
    for k, v in settings.items():
        out |= flat(v, f"{above}{k}.") if isinstance(v, dict) else {above + k: v}
    return out


SETS = {
    "base": (None, {"a": {"x": "1", "y": {"z": "2"}}, "b": "3", "access": {"wait": "5"}}),
    "mid": ("base", {"a": "plain", "b": {"c": "4"}, "access": {"agent": "q"}}),
    "top": ("mid", {"a": {"w": "6"}, "access": {"wait": "7"}}),
    "other": ("base", {"a": {"y": "flat"}}),
    "lost": ("nobody", {"k": "v"}),
    "one": ("two", {"p": "1"}),
    "two": ("one", {"p": "2", "q": "3"}),
}


def test_inherited_settings_are_merged_in_depth(spark):
    links = spark.createDataFrame([(n, p) for n, (p, _) in SETS.items()] + [(None, "base")], "name string, parent string")
    lines = rulesets.lineage(links)
    got = {(r.name, r.ancestor): (r.distance, r.state) for r in lines.collect()}
    assert got["top", "base"] == (2, "found") and got["lost", "nobody"] == (1, "missing") and got["one", "two"] == (1, "found")
    assert {(r.name, r.ancestor) for r in lines.filter("state = 'cycle'").collect()} == {("one", "one"), ("two", "two")}
    settings = spark.createDataFrame([(n, k, v) for n, (_, s) in SETS.items() for k, v in flat(s).items()], "name string, path string, value string")
    own = rulesets.effective(settings, lines)
    have = {}
    for r in own.collect():
        have.setdefault(r.name, {})[r.path] = r.value
    for name in ("base", "mid", "top", "other", "lost"):
        chain, at = [], name
        while at in SETS:
            chain.append(SETS[at][1])
            at = SETS[at][0]
        want = {}
        for s in reversed(chain):
            want = merged(want, s)
        assert have[name] == flat(want)
    assert have["one"] == {"p": "1", "q": "3"}
    lent = rulesets.with_access(own, spark.createDataFrame([("lost", "top"), ("other", "mid")], "name string, parent string"))
    rows = {(r.name, r.path): (r.value, r.origin) for r in lent.collect()}
    assert rows["lost", "access.wait"] == ("7", "top") and rows["other", "access.wait"] == ("5", "base") and rows["other", "access.agent"] == ("q", "mid") and ("lost", "a.w") not in rows


# pages


@pytest.mark.parametrize("most", [None, 3])
def test_levels_of_pages(spark, most):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(1, None), (None, 2), (5, 5)]
    roots = [("r", 0), ("r", 1), ("s", 7), ("s", None)]
    want = {}
    for root in "rs":
        level, front = 0, {p for q, p in roots if q == root and p is not None}
        seen = set()
        while front and (most is None or level <= most):
            want |= {(root, p): level for p in front}
            seen |= front
            front = {b for a, b in links if a in front and b is not None} - seen
            level += 1
    got = queue.page_levels(spark.createDataFrame(roots, "root string, page long"), spark.createDataFrame(links, "page long, target long"), most)
    assert sorted((r.root, r.page, r.level) for r in got.collect()) == sorted((*k, v) for k, v in want.items())


# brackets


def slow_pairs(text, depth):
    """All pairs by matching each opening bracket on its own, then those that no other pair holds."""
    pairs, partner = [], {}
    for i, c in enumerate(text):
        if c == ")":
            for j in range(i - 1, -1, -1):
                if text[j] == "(" and j not in partner:
                    partner[j] = i
                    pairs.append((j, i))
                    break
    closed = lambda j, i: partner.get(j, len(text)) > i
    counted = [(j, i) for j, i in pairs if sum(text[k] == "(" and closed(k, i) for k in range(j)) < depth]
    return sorted(p for p in counted if not any(q[0] < p[0] and p[1] < q[1] for q in counted))


def test_outermost_pairs():
    r = random.Random(1)
    for _ in range(600):
        text = "".join(r.choice("(()) x") for _ in range(r.randrange(25)))
        for depth in (1, 2, 50):
            pairs, unclosed, unopened = brackets.scan(text, "(", ")", depth)
            assert pairs == slow_pairs(text, depth)
        inside = {k for p in slow_pairs(text, 50) for k in range(p[0], p[1] + 1)}
        assert not inside & set(unopened) and all(text[k] == "(" for k in unclosed) and all(text[k] == ")" for k in unopened)
        assert text.count("(") - len(unclosed) == text.count(")") - len(unopened)
    deep = "(" * 60 + ")" * 60
    assert brackets.scan(deep, "(", ")")[0] == [(0, 119)]
    assert brackets.scan("(" * 100_000 + ")" * 99_999, "(", ")", 50)[1] == [0]


def test_joined_and_context(spark):
    assert brackets.join("「ああ…\n　いい『う\nえ』」\n「お\n", "「", "」") == "「ああ…。いい『うえ』」\n「お\n"
    text = "0123456789abcdefghij(klmnopqrstuvwxyz"
    assert one(spark, brackets.context(F.col("t"), F.lit(20)), t=text) == text[5:36]
    row = one(spark, brackets.bracket_scan(F.col("t"), "(", ")"), t=")(a)(")
    assert ([tuple(p) for p in row.pairs], row.unclosed, row.unopened) == ([(1, 3)], [4], [0])


def test_brackets_in_an_open_one_are_joined():
    assert brackets.join("「a\n「b\nc」d", "「", "」") == "「a\n「bc」d"
    long = "「" + "う\n" * 7 + "」"
    assert brackets.join(long, "「", "」", lines=7) == long and brackets.join("「" + "う" * 398 + "\n」", "「", "」", length=400).count("\n") == 1
