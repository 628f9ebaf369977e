import html
import re

import numpy as np
import pytest

from hazegrid.llm import maintext
from hazegrid.llm.dom import Page

from .conftest import prose


def template(i, paragraphs):
    body = "".join(f"<p>{html.escape(p)}</p>" if k % 3 else f"<p><b>{html.escape(p)}<br>" for k, p in enumerate(paragraphs))
    links = "".join(f'<li><a href="/{k}">{prose(1, k)}</a></li>' for k in range(6))
    return (f'<!DOCTYPE html><html><head><title>{prose(5, i)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav>'
            f'<div class="ad">{prose(9, i + 3)}</div><article><h1>{html.escape(paragraphs[0][:30])}</h1>{body}</article><footer>&copy; {prose(12, i)}</footer>')


def known(i):
    return [" ".join(prose(6 + (i * 7 + k * 13) % 60, i * 10 + k).split()) + " & <so> on." for k in range(1 + i % 7)]


def expected(paragraphs):
    return "\n\n".join([" ".join(paragraphs[0][:30].split()), *paragraphs])


@pytest.fixture(scope="module")
def extractor():
    return maintext.train([template(i, known(i)) for i in range(80)])


def test_held_out_pages_are_exact(extractor):
    pages = [known(i) for i in range(100, 180)]
    assert extractor([Page(template(100 + i, p)) for i, p in enumerate(pages)]) == [expected(p) for p in pages]


def test_held_out_layouts(extractor):
    """Other containers and names, with adverts and reader comments: shared characters of the blocks, and exact pages."""
    sources = [known(i) for i in range(200, 400)]
    layouts, exact, scores = maintext.Layouts(sources, 99), 0, []
    for s in sources:
        page = Page(layouts.page(s))
        want = [t for n, t in zip(page.run_node, page.run_text) if page.mark[n] == "1"]
        got = extractor([page])[0].split("\n\n")
        hits = sum(len(t) for t in got if t in want)
        scores.append(2 * hits / max(1, sum(map(len, want)) + sum(map(len, got))))
        exact += got == want
    assert np.mean(scores) > 0.97 and exact > 0.85 * len(sources)


def test_pages_written_by_hand(extractor):
    p = [" ".join(prose(40, k).split()) + "." for k in range(4)]
    page = (f'<body><div class="site-header"><a href="/">Home</a> <a href="/n">News</a></div><div class="cookie-notice">We use cookies to do this and that. <button>Accept</button></div>'
            f'<div id="wrapper"><div class="post-content"><h2>Title here</h2><p>{p[0]}<p>{p[1]}<div class="advert">Buy now, pay later, offer ends soon.</div><ul><li>first item of the list<li>second item of it</ul><p>{p[2]}</div>'
            f'<div class="sidebar"><h3>Related</h3><ul><li><a href="a">one story</a><li><a href="b">another story</a></ul></div><div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>{p[3]}</p></div>'
            f'<form><textarea>Your reply</textarea><input type=submit></form></div></div><div class="footer">&copy; 2020 Someone <a href="c">Contact</a></div>')
    assert extractor([Page(page)])[0].split("\n\n") == ["Title here", p[0], p[1], "first item of the list", "second item of it", p[2]]


def test_decoding_equals_all_labellings(extractor):
    """The likeliest of all labellings around* main* cut* along every path."""
    rng = np.random.default_rng(0)
    for _ in range(40):
        nodes = maintext.Nodes([Page("<div>a<section>b</section><p>c</p></div>"[: int(rng.integers(5, 60))] + "<ul><li>d<li>e</ul>" * int(rng.integers(0, 2)))])
        chance = rng.random(nodes.n)
        weight = 0.3 + np.log1p(nodes.chars)
        best = None

        def walk(i, states):
            nonlocal best
            if i == nodes.n:
                value = sum(w * np.log(c if s == 1 else 1 - c) for w, c, s in zip(weight, chance, states))
                best = value if best is None or value > best else best
                return
            above = states[nodes.parent[i]] if i else 0
            for s in range(above, 3):
                if i or s < 2:
                    walk(i + 1, [*states, s])

        walk(0, [])
        keep = maintext.decode(nodes, chance)
        assert np.isclose(sum(w * np.log(c if k else 1 - c) for w, c, k in zip(weight, np.clip(chance, 1e-4, 1 - 1e-4), keep)), best)
        for i in range(nodes.n):  # nothing is kept below a cut
            chain, j = [], i
            while j >= 0:
                chain.append(bool(keep[j]))
                j = nodes.parent[j]
            assert re.fullmatch("0*1*0*", "".join("01"[k] for k in reversed(chain)))


def test_trees_learn_and_stay_calm():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = maintext.Boosted(rounds=40).fit(x[:2000], y[:2000])
    assert ((model.chance(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    flat = maintext.Boosted(rounds=3).fit(np.zeros((10, 2)), np.ones(10))
    assert (flat.chance(np.zeros((2, 2))) > 0.5).all()


@pytest.mark.parametrize("source, runs", [
    ("<p>a<p>b <b>c</b>&amp;d<br>e<ul><li>x<li>y</ul>tail", ["a", "b c&d e", "x", "y", "tail"]), ("a < b <c", ["a < b"]), ("<p title=it's>ok</p>", ["ok"]),
    ("<!-- x --><p>y<!-->z", ["yz"]), ("<table><tr><td>1<td>2<tr><td>3</table>z", ["1", "2", "3", "z"]), ("<div><p>x</div>y</p>z", ["x", "yz"]),
    ("<script>'<p>no'</script>w<noscript>no</noscript>v", ["w", "v"]), ("<h1>t<h2>u</h2>", ["t", "u"]), ("", []), ("<a <a \"<a \"", []), ("<p>&copy;&am &#x41;&nbsp; b", ["©&am A b"]),
])
def test_reader(source, runs):
    assert Page(source).run_text == runs


def test_long_and_hostile_pages_are_read_in_linear_time():
    for s in ("<p>", "<div>", "<a b=\"", "<!--", "<li><p>", "<p><table><td>", "<", "&", "<a b='x\" "):
        Page(s * 60_000)


def test_query(spark):
    pages = [(i, f"u{i}", template(i, known(i)), 1, "x") for i in range(60)]
    pages += [(60, None, None, 1, "x"), (61, "u", "", 1, "x"), (None, "u", template(61, known(61)), 1, "x"), (3, "u3", template(3, known(3)), 1, "x"), (62, "u", "plain text only", 1, "x"),
              (63, "u", template(63, [prose(50, 1)] * 3000), 1, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text int, n_chars string")
    got = {(r.page_id, r.url): r for r in maintext.main_texts(frame).collect()}
    assert got[60, None].text == got[61, "u"].text == "" and got[60, None].n_chars == 0
    for i in range(60):
        assert got[i, f"u{i}"].text == expected(known(i)) and got[i, f"u{i}"].n_chars == len(expected(known(i)))
    assert got[None, "u"].text == expected(known(61))
    assert got[63, "u"].text.count("\n\n") == 3000
    assert maintext.main_texts(frame).count() == len(pages)


def test_without_marked_pages_or_rows(spark):
    frame = spark.createDataFrame([(1, "u", "<div class=post><p>" + prose(60, 1) + "<p>" + prose(70, 2) + "</div>")], "page_id long, url string, html string")
    assert maintext.main_texts(frame).count() == 1
    assert maintext.main_texts(frame.limit(0)).count() == 0
