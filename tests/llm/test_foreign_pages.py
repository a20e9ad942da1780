"""Pages in layouts that the example generator does not know, and markup that is broken on purpose."""

import random
import time

import pytest

from strandworks.llm import html_extract

WORDS = "the river rose in spring and took a bridge with it while people on both banks stood and watched as water went down".split()


def prose(r, n):
    s = " ".join(r.choice(WORDS) for _ in range(n))
    return s.capitalize() + "."


def press(r):
    """A news site: a theme's class names, teasers around the story."""
    ps = [prose(r, r.randint(15, 60)) for _ in range(r.randint(3, 12))]
    title, quote = prose(r, 6), prose(r, 12)
    teaser = "".join(f'<div class="c-card"><a href="/{i}"><h3>{prose(r, 5)}</h3></a><span>{r.randint(1, 9)} min</span></div>' for i in range(4))
    page = f"""<!doctype html><html><head><title>{title}</title><script>if (a < b) {{ x = "<p>no</p>"; }}</script></head><body class="home">
    <header class="l-masthead"><a href="/">Daily</a><nav><a href="/w">World</a> <a href="/s">Sport</a></nav></header>
    <div class="l-page"><main><article itemscope><h1>{title}</h1><p>{ps[0]}</p><blockquote><p>{quote}</p></blockquote>
    {"".join(f"<p>{p}</p>" for p in ps[1:])}</article></main>
    <aside class="l-rail"><h2>Most read</h2>{teaser}</aside></div>
    <footer><ul><li><a href="/a">About</a></li><li><a href="/t">Terms</a></li></ul><small>&copy; Daily</small></footer></body></html>"""
    return page, [title, ps[0], quote, *ps[1:]]


def weblog(r):
    """A weblog: everything is a div, reader comments behind the entry."""
    ps = [prose(r, r.randint(15, 60)) for _ in range(r.randint(3, 12))]
    title = prose(r, 5)
    items = [prose(r, 8) for _ in range(3)]
    page = f"""<html><body><div id="wrap"><div id="masthead"><div class="site-title"><a href="/">My notes</a></div></div>
    <div id="access"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></div>
    <div class="post-entry"><h2>{title}</h2>{"".join(f"<p>{p}" for p in ps)}<ul>{"".join(f"<li>{x}" for x in items)}</ul></div>
    <div id="comments"><h3>{r.randint(2, 9)} replies</h3><ol class="commentlist">{"".join(f"<li><cite>Ann</cite><p>{prose(r, 14)}</p></li>" for _ in range(3))}</ol>
    <form action="/c"><label>Name</label><input name="n"><select><option>Mr</option><option>Ms</option></select><button>Send</button></form></div>
    <div id="sidebar"><div class="widget"><h4>Archive</h4><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div></div>
    <div id="colophon">Powered by a machine</div></div></body></html>"""
    return page, [title, *ps, *items]


@pytest.mark.parametrize("make", [press, weblog])
def test_foreign_layouts(make):
    r = random.Random(4)
    made = [make(r) for _ in range(60)]
    got = html_extract.extract([p for p, _ in made], html_extract.train())
    right = sum(g == "\n".join(want) for g, (_, want) in zip(got, made, strict=True))
    assert right >= 0.9 * len(made), (right, got[0], made[0][1])


def texts(page):
    return [t for _, t, _ in html_extract.blocks_of(html_extract.parse(page))[1]]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p class="a" title=5">Hello world.</p><p class="b">More.</p>', ["Hello world.", "More."]),
        ("<p don't>It is a text.</p><p>That's it then.</p>", ["It is a text.", "That's it then."]),
        ("<article><p>A</p><svg width=1><p>B</p></article><p>C", ["A", "B", "C"]),
        ("<article><p>A</p><object data=x>B<p>C</p></article>D", ["A", "B", "C", "D"]),
        ("<article>A<select><option>1<p>B</p></article>", ["A", "1", "B"]),
        ("<article>A<canvas>B</article>C", ["AB", "C"]),
        ("<article>A<noscript>B</noscript>C</article>", ["A", "B", "C"]),
        ("<p>E = <math><mi>m</mi><mo>c</mo></math> holds.", ["E = mc holds."]),
        ("<template><p>x</p></template><p>A</p><template><p>B</p>", ["A", "B"]),
        ("<title>x</title><iframe>y</iframe>A<textarea>B", ["AB"]),
        ("<div><script>a = '<p>'</div>B", ["B"]),
        ("<SCRIPT>a</scripty></SCRIPT>B<style>c</STYLE >D", ["BD"]),
        ("1 < 2 <!-- no --> <!-> a<!x>b <b>c", ["1 < 2 ab c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("a</p>b<br/>c</br>d &lt;p&gt; &#233;&nbsp;x", ["a", "b c d <p> é x"]),
        ('<p title="a>b">x</p><a href=y/>z</a><p title="never closed>w', ["x", "z", "w"]),
        ("", []),
        ("plain", ["plain"]),
    ],
)
def test_markup(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("part", ["<b>", "<div>", "</x>", "<ul><li>", "<!--", "<svg>", "<script>", "<iframe>", "<a b='", '<p c="', "<td>", "<select>", "</p>", "<"])
def test_parser_is_linear(part):
    n = 1_000_000 // len(part)
    for page in (part * n + ">", "<b>" * (n // 2) + part * (n // 2) + "</b>" * (n // 2)):
        start = time.perf_counter()
        html_extract.blocks_of(html_extract.parse(page))
        assert time.perf_counter() - start < 8
