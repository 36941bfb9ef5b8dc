import pytest

from quire.operators.rules import parsed, selected, value_of

PAGE = """<div id="list" class="a b"><h2 lang="en-GB">One</h2><ul><li class="x">1</li><li class="x y">2</li><li>3</li><li data-k="v w">4</li></ul>
<h2 lang="english">Two</h2><p>p1</p><p class="skip">p2</p><p>p3 <a href="/t.html" rel="next nofollow">t</a><a href='/u'></a></p></div><p>out</p>"""


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li.x", "1 2"),
        ("li:nth-child(2n+1)", "1 3"),
        ("li:nth-child(even)", "2 4"),
        ("li:nth-child(-n + 2)", "1 2"),
        ("li:nth-child(3)", "3"),
        ("li:nth-last-child(1), li:first-child", "1 4"),
        ("li:not(.x)", "3 4"),
        ("li:not(.x, [data-k])", "3"),
        ("li.x + li", "2 3"),
        ("li.y ~ li", "3 4"),
        ("h2 + p", "p1"),
        ("#list > h2 ~ p:not(.skip)", "p1 p3 t"),
        ("ul ~ h2", "Two"),
        ("[lang|=en]", "One"),
        ("[rel~=next]", "t"),
        ("[rel=next]", ""),
        ("a[href$='.html']", "t"),
        ("a[href^='/'][href*=\"t.\"]", "t"),
        ("p:is(.skip, .none), a:empty", "p2 "),
        ("div.a.b > ul > :last-child", "4"),
        ("body p", ""),
        ("[data-k='v w']", "4"),
        ("*.y", "2"),
    ],
)
def test_selectors(selector, want):
    assert " ".join(e.text() for e in selected(parsed(PAGE), selector)) == want


def test_inside_an_element_and_errors():
    root = parsed(PAGE)
    ul = selected(root, "ul")[0]
    assert [e.text() for e in selected(ul, "li + li")] == ["2", "3", "4"]
    assert selected(ul, "div li") == [] and value_of(ul, "li:last-child::attr(data-k)") == "v w"
    for wrong in ("li:hover", "li >> a", "li:nth-child(x)", "", "a,,b", "li[", "> li", "li +"):
        with pytest.raises(ValueError, match="no "):
            selected(root, wrong)
