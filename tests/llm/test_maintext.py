import math
import random
import time
from xml.etree import ElementTree

from clausemill.llm import maintext
from clausemill.llm.maintext import extract, main_text

WORDS = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 6


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_article_without_surroundings():
    html = page(
        f'<header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>One.</b> two<br>three&nbsp;four<p>{WORDS}</p>'
        f'<aside>More</aside><form>Name <input><button>Go</button></form><div class="comments">Nice!</div><p>La<b>st</b></p></article><div id="cookie-notice">We use</div><footer>&copy; x</footer>'
    )
    assert main_text(html) == f"Head & line One. two three four {WORDS.strip()} Last"


def test_without_article_element():
    html = page(f'<div><a href="a">x</a> <a href="b">y</a> <a href="c">menu entry</a></div><div class="content with-sidebar"><h2>Title here</h2><p>{WORDS}</p><p>{WORDS}</p><ul><li>{WORDS}</li></ul></div><div class="sidebar"><p>{WORDS}</p></div>')
    text = main_text(html)
    assert text.startswith("Title here") and text.count("Alpha") == 18 and "menu" not in text


def test_sections_beside_each_other():
    html = page(f"<section><p>{WORDS}</p><p>{WORDS}</p></section><section><p>{WORDS}</p></section><div><a href=x>{WORDS}</a></div>")
    assert main_text(html).count("Alpha") == 18


def test_odd_pages():
    for html in (None, "", "   ", "<html><body></body></html>", page("<script>x</script>"), "<"):
        assert main_text(html) == "" or html == "<"
    assert main_text("just text &lt;b&gt;") == "just text <b>"
    assert main_text(page("<p>unclosed <b>bold<p>next")) == "unclosed bold next"
    assert main_text(page("<article><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>")) == "deep"
    assert main_text(page("<article><table><tr><td>a<td>b<tr><td>c</table></article>")) == "a b c"
    assert main_text(page("<article><p>a</p><!-- no --><p>b &bogus; &#x41;</p></article>")) == "a b &bogus; A"


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{WORDS}</p></article>"), "t", 5), (1, "u", page(f"<article><p>{WORDS}</p></article>"), "t", 5), (None, None, None, None, None), (3, "v", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(extract(df).collect(), key=str)
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == sorted([(1, "u", WORDS.strip(), len(WORDS.strip()))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=lambda r: f"Row(page_id={r[0]}")
    assert extract(df.limit(0)).count() == 0


def test_several_articles_beside_each_other():
    posts = "".join(f"<article><h2>Part {i}</h2>{f'<p>{WORDS}</p>' * n}</article>" for i, n in enumerate((2, 12, 2)))  # the core is in the second
    comments = f'<article class="comment"><p>Nice {WORDS}</p></article><div class="comments"><article><p>Nice {WORDS}</p></article></div>'
    cards = f'<article><a href="x"><p>Teaser {WORDS}</p></a></article>'
    for html in (page(posts + comments + cards), page(f"<div><div>{posts}</div>{comments}{cards}</div>")):
        text = main_text(html)
        assert [f"Part {i}" in text for i in range(3)] == [True] * 3 and text.count("Alpha") == 96
        assert "Nice" not in text and "Teaser" not in text


LONG = "Prose that goes on for a while, as an article does, without a single link in it. " * 5
LINKS = " ".join(f'<a href="/{i}">entry number {i}</a>' for i in range(12))
#: (body, what must be there, what must not), without article or main elements: densities decide.
PLAIN_PAGES = (
    (f'<div class="x1">{LINKS}</div><div class="x2"><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div class="x3">{LINKS}</div>', ["Title", "Prose"], ["entry"]),
    (f'<div><div>{LINKS}<p>Short.</p></div><div><div><p>{LONG}</p><p>{LONG}</p><p>End.</p></div></div></div><table><tr><td>{LINKS}</td></tr></table>', ["Prose", "End."], ["entry"]),
    (f'<div>{"<span>tiny</span>" * 30}</div><div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></div><ul>{"<li>x</li>" * 30}</ul>', ["Title", "Prose"], ["tiny"]),
    (f'<div>{"<b>i</b><br>" * 40}</div><section><p>{LONG}</p></section><section><p>{LONG}</p><p>{LONG}</p></section><div>{"<i>k</i>" * 40}</div>', ["Prose"], ["i i i", "kkk"]),
)


def test_density_decides_where_no_element_is_marked(monkeypatch):
    for body, there, gone in PLAIN_PAGES:
        text = main_text(page(body))
        assert all(x in text for x in there) and not any(x in text for x in gone), text
        assert text.count("Prose") == body.count("Prose")
    right = [main_text(page(body)) for body, *_ in PLAIN_PAGES]
    monkeypatch.setattr(maintext, "density", lambda *_: 1.0)
    assert all(main_text(page(body)) != want for (body, *_), want in zip(PLAIN_PAGES, right))


def test_names_are_weak_evidence():
    for body, n in ((f'<div class="search-results"><p>{WORDS}</p></div>', 6), (f'<div><p>{WORDS}</p><p id="social-history">{WORDS}</p><p>{WORDS}</p></div>', 18), (f'<div class="notice"><p>{WORDS}</p></div>', 6), (f'<div class="comments"><p>{WORDS}</p></div>', 6)):
        assert main_text(page(body)).count("Alpha") == n
    for mark in ("sidebar", "ad-slot", "comment-list", "site-footer", "cookie-banner", "share buttons", "related-posts"):
        text = main_text(page(f'<div><p>{LONG}</p><p>{LONG}</p></div><div class="{mark}"><p>{WORDS}</p></div>'))
        assert "Prose" in text and "Alpha" not in text, mark
    # Comments stay out however long they are.
    assert "Alpha" not in main_text(page(f'<div><p>{LONG}</p><p>{LONG}</p></div><div id="comments">{f"<p>{WORDS}</p>" * 30}</div>'))


def slow_densities(node, body_links):
    """(characters, link characters, tags, link tags) of an element tree, and all densities, by recursion."""
    found = []

    def visit(e, linked):
        linked = linked or e.tag == "a"
        own = len("".join((e.text or "").split()))
        sums = [own, own * linked, 0, 0]
        for child in e:
            below = visit(child, linked)
            tail = len("".join((child.tail or "").split()))
            sums = [sums[0] + below[0] + tail, sums[1] + below[1] + tail * linked, sums[2] + below[2] + 1, sums[3] + below[3] + (linked or child.tag == "a")]
        found.append((e.tag, sums))
        return sums

    whole = visit(node, False)
    share = whole[1] / whole[0] if body_links is None else body_links
    out = {}
    for tag, (c, lc, t, lt) in found:
        lc, t, lt, plain = max(1, lc), max(1, t), max(1, lt), max(1, c - lc)
        base = math.log(c / plain * lc + share * c + math.e)
        out.setdefault(tag, []).append(c / t * math.log(max(1.0, c / lc * t / lt), base) if c else 0.0)
    return out


def test_densities_against_recursion():
    rng = random.Random(0)

    def some(depth):
        tag = rng.choice(["div", "section", "div", "blockquote"]) if depth else rng.choice(["p", "p", "h2", "li"])
        inner = "".join(some(depth - 1) for _ in range(rng.randint(1, 4))) if depth else " ".join(rng.choices(["alpha", "be", "gamma rays", '<a href="x">link text</a>', "<b>bold</b>"], k=rng.randint(1, 12)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        body = f"<body>{''.join(some(rng.randint(0, 3)) for _ in range(4))}</body>"
        tree = maintext.Tree()
        tree.read(body)
        counts = maintext.Counts(tree, [False] * len(tree.tag))
        share = counts.links[1] / counts.chars[1]
        got = {}
        for i in range(1, len(tree.tag)):
            got.setdefault(tree.tag[i], []).append(maintext.density(counts.chars[i], counts.links[i], counts.tags[i], counts.link_tags[i], share))
        want = slow_densities(ElementTree.fromstring(body), None)
        assert {t: sorted(round(x, 9) for x in v) for t, v in got.items()} == {t: sorted(round(x, 9) for x in v) for t, v in want.items()}


def test_hostile_pages_take_linear_time():
    n = 100_000
    for html in ("<div>" * n + "x", "<body>" + "</b>" * n + "x", "<p>x" + "</div>" * n, "<b>" * n + "x", "<b>" * (n // 2) + "<p>a" * (n // 2), "<p><div>" + "<b>" * (n // 2) + "<hr>" * (n // 2), "<!--" * n, "<!-- >" * n, "<a " * n, "<![CDATA[ >" * n, "<script>" + "</x " * n + ">", "<article>" * n + "x"):
        began = time.process_time()
        main_text(html)
        assert time.process_time() - began < 10, html[:20]


def test_very_long_page():
    text = main_text(page(f"<article>{'<p>' + 'word ' * 1000 + '</p>'}</article>".replace("</article>", ("<p>" + "word " * 1000 + "</p>") * 400 + "</article>")))
    assert text.count("word") == 401_000


def test_cut_off_pages():
    assert main_text("<body><p>One</p><p>two <b") == "One two"
    assert main_text("<body><p>One</p><!-- not ended <p>two</p>") == "One"
    assert main_text("<body><p>One</p><![CDATA[two]]><p>three &lt 4</p>") == "One three < 4"
