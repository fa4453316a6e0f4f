"""Wrappers of hosts and the main texts that they give, against pages whose parts are known."""

import random
import re
from html import escape, unescape

import pytest

from passbook.llm import wrappers

PAGE = "page_id long, url string, html string"


def stream(html):
    return wrappers.Reader(html).root


def learnt(*pages):
    known = {}
    for page in pages:
        wrappers._joined(known, "h", 1, wrappers.wrapper_of(stream(page)))
    return known["h"]


def shape(parts):
    """A wrapper as an expression: ? optional, + repeated, # slot."""
    out = []
    for p in parts:
        inner = shape(p.parts)
        name = ("#" if p.const is None else "=") if p.key is None else f"({inner})" if isinstance(p.key, tuple) else f"{p.key}[{inner}]"
        out.append(name + "+" * p.repeated + "?" * p.optional)
    return " ".join(out)


def sentence(rng):
    return " ".join(rng.choice("alpha beta gamma & delta < épée 5 > zeta".split()) for _ in range(rng.randrange(3, 20))) + "."


def made_page(rng, layout):
    """(html, main text) of a page with everything around it."""
    title, paragraphs = sentence(rng), [sentence(rng) for _ in range(rng.randrange(1, 6))]
    body, text = [], [title]
    for n, p in enumerate(paragraphs):
        inner = escape(p).replace(" ", rng.choice([" ", "\n", " \t"]), 1)
        body.append(rng.choice([f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}</b><br>", f"<div class='text-{n}'>{inner}</div>"]))
        text.append(p)
    if rng.random() < 0.4:
        body.append("<ul><li>One</li><li>Two<li>Three</ul>")
        text += ["One", "Two", "Three"]
    if rng.random() < 0.4:
        body.append(f"<table><tr><td>{escape(sentence(rng))}<td>x</table>")
        text += [unescape(re.search("<td>(.*?)<td>", body[-1])[1]), "x"]
    inside = f"<h1>{escape(title)}</h1>" + "".join(body)
    noise = {
        "nav": "<nav><ul>" + "".join(f"<li><a href='/{i}'>{sentence(rng)[:9]}</a></li>" for i in range(rng.randrange(1, 5))) + "</ul></nav>",
        "header": f"<header><p>Site {rng.randrange(9)}</p></header>",
        "ad": f'<div class="ad-box">{escape(sentence(rng))}</div>',
        "notice": f'<div id="cookieNotice"><p>We use {rng.randrange(99)} cookies</p><form><label>Mail</label><button>Go</button></form></div>',
        "script": '<script>var t="</p><article>x</article>";</script><style>p{}</style><!-- <p>no</p> -->',
        "side": f"<aside><h2>More</h2><p>{escape(sentence(rng))}</p></aside>",
    }
    before = "".join(noise[k] for k in ("header", "nav", "ad", "script") if rng.random() < 0.8)
    after = "".join(noise[k] for k in ("side", "notice", "script", "ad") if rng.random() < 0.8)
    comments = "".join(f"<div class='comment'><p>{escape(sentence(rng))}</p></div>" for _ in range(rng.randrange(4)))
    comments = f"<section class='comments'>{comments}</section>" if comments else ""
    main = {"article": f"<article>{inside}{comments}</article>", "main": f"<main>{inside}{comments}</main>", "plain": f"<div class='post'>{inside}</div>{comments}"}[layout]
    html = f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body>{before}{main}{after}<footer>&copy; someone</footer>"
    return html + rng.choice(["", "</body></html>"]), "\n\n".join(re.sub(r"\s+", " ", t) for t in text)


@pytest.mark.parametrize("room", [wrappers.BROADCAST, 0])
def test_main_texts(spark, room):
    """Articles, main parts and plain pages; one host holds most pages; joined without a broadcast too."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(160):
        layout = rng.choice(["article", "main", "plain"])
        html, text = made_page(rng, layout)
        name = layout if rng.random() < 0.7 else f"{layout}{rng.randrange(9)}"
        rows.append((i, f"HTTPS://user@{name}.example.com:80/{i}?q#x", html))
        want[i] = text
    found = wrappers.extract(spark.createDataFrame(rows, PAGE).repartition(7), room).collect()
    assert len(found) == 160
    for r in found:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), rows[r.page_id]


def test_awkward_pages(spark):
    long = "word " * 300_000
    rows = [
        (1, None, None, "x", 1), (1, None, None, "x", 1), (2, "http://a/", "", None, None), (3, "http://a/", "just text &amp; more", "p", 2),
        (None, "no url", "<p>a<p>b", "p", 2), (4, "http://a/", "<article><p>" + long + "</article>", "p", 2), (5, "http://b/", "<div>" * 3000 + "deep" + "</div>" * 3000, "p", 2),
        (6, "http://b/", "<article>copy</article>", "p", 2), (7, "http://b/", "<article>copy</article>", "p", 2), (8, "http://c/", "<p class='x' <b", "p", 2), (9, "http://c/", "<!-- open <p>x", "p", 2),
    ]
    pages = spark.createDataFrame(rows, PAGE + ", places string, host int")
    found = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert found == {1: "", 2: "", 3: "just text & more", None: "a\n\nb", 4: long.strip(), 5: "deep", 6: "copy", 7: "copy", 8: "", 9: ""}
    assert wrappers.extract(pages).count() == len(rows)
    assert wrappers.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_wrappers_hold_optionals_groups_and_slots():
    pages, parts = learnt("<h1>a</h1><p>x</p>", "<h1>b</h1><div>same</div><p>y</p><p>z</p>", "<h1>c</h1><div>same</div><p>y</p>")
    assert (pages, shape(parts)) == (3, "h1[#] div[=]? p[#]+")
    assert shape(learnt("<dl><dt>a<dd>b<dt>c<dd>d</dl>")[1]) == "dl[(dt[#] dd[#])+]"
    assert shape(learnt("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>")[1]) == "dl[(dt[#] dd[#])+]"
    assert shape(learnt("<h2>a</h2><table></table>", "<table></table><h2>a</h2>")[1]) in ("table[]? h2[=] table[]?", "h2[=]? table[] h2[=]?")


def test_order_of_merging_keeps_every_token():
    """Whatever order pages come in, each page finds all its texts in the wrapper."""
    rng = random.Random(3)
    pages = ["".join(rng.choice(["<h2>t</h2>", "<p>u</p>", "<dl><dt>v<dd>w</dl>", "<ol><li>x</ol>"]) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    for _ in range(5):
        rng.shuffle(pages)
        count, parts = learnt(*pages)
        assert sum(p.size() for p in parts) < 60
        places = wrappers.Places(wrappers.rated(parts, count))
        for page in pages:
            assert len(list(places.texts(stream(page)))) == len(re.findall("[tuvwx](?=<|$)", page))


def test_template_texts_are_left_out():
    """Without article or main part, what all pages of a host share is template, and so are lists of links."""
    page = "<div>Read our offers.</div><div>{}</div><ul><li><a href='/'>Home and {}</a></ul>"
    count, parts = learnt(*(page.format(f"News {i}.", i) for i in range(4)))
    places = wrappers.Places(wrappers.rated(parts, count))
    assert wrappers.main_text(page.format("News 9.", 9), places) in ("News 9.", "Read our offers.\n\nNews 9.")
    page = "<h4>Read our offers.</h4><div>{}</div><ul><li><a href='/'>Home and {}</a></ul>"
    count, parts = learnt(*(page.format(f"News {i}.", i) for i in range(4)))
    assert wrappers.main_text(page.format("News 9.", 9), wrappers.Places(wrappers.rated(parts, count))) == "News 9."
