import numpy as np
import pytest
from binfall.llm import boosting, htmlmain


@pytest.fixture(scope="module")
def trees():
    return htmlmain.forest()


def test_held_out_made_up_pages(trees):
    right, pages = [], htmlmain.samples(120, seed=1234)
    for page, labels in pages:
        inside = htmlmain.decode(page, trees.probability(htmlmain.features([page])))
        right.append(htmlmain.text_of(page, inside) == htmlmain.text_of(page, labels.astype(bool)))
    assert np.mean(right) >= 0.9


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style>
<script>var t="</p><article>no</article>";track(0);</script></head><body><nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>
<!-- ad 0 <p>x</p> --><div class="ad">Buy this now for less.</div><article><h1>Caf&eacute; &amp; &#8364;&#x31;</h1>
<p><b>First   part, bold and long enough to be prose,\n with lines.<br><p>Second part; it holds a <a href="/x">link</a> and&nbsp;more words, too.</p>
<p>Third, with &lt;b&gt; and 1 < 2 in it, and quite some words that follow after it.</p></article><footer>Imprint and rights</footer></body></html>"""


def test_a_page(trees):
    assert htmlmain.extract([PAGE], trees) == ["Café & €1\nFirst part, bold and long enough to be prose, with lines.\nSecond part; it holds a link and more words, too.\nThird, with <b> and 1 < 2 in it, and quite some words that follow after it."]


SENTENCES = [
    "The harbour was quiet when the first boats came back, and nobody had expected them before the evening tide.",
    "Old fishermen stood along the wall and counted the sails, as their fathers had done in every autumn they could remember.",
    "A boy ran down the steps with a lantern, although it was still light enough to read the names on the bows.",
    "By nightfall all but two had been moored, and the talk in the tavern turned to the weather beyond the cape.",
    "The council met on the following morning to decide whether the lighthouse should be repaired before winter.",
    "In the end they voted for the repairs, and the masons began their work in the first week of October.",
]
PARAGRAPHS, LINES = "".join(f"<p>{s}</p>" for s in SENTENCES), "\n".join(SENTENCES)
HOME = '<a href="/">Home</a> <a href="/b">About</a>'
LAYOUTS = {
    "body": (f"<html><body>{PARAGRAPHS}</body></html>", LINES),
    "menu and footer": (f"<html><body><nav>{HOME}</nav><h1>Title of it</h1>{PARAGRAPHS}<footer>Copyright 2024 Example</footer></body></html>", f"Title of it\n{LINES}"),
    "div": (f"<html><body><div>{PARAGRAPHS}</div></body></html>", LINES),
    "wrapped div": (f'<html><body><div id="wrapper"><div class="row"><div class="col">{PARAGRAPHS}</div></div></div></body></html>', LINES),
    "main": (f"<html><body><main>{PARAGRAPHS}</main></body></html>", LINES),
    "section": (f"<html><body><section>{PARAGRAPHS}</section></body></html>", LINES),
    "table cell": (f'<html><body><table><tr><td><a href="/">Home</a><br><a href="/x">More</a></td><td>{PARAGRAPHS}</td></tr></table></body></html>', LINES),
    "long article": (f"<html><body><article>{PARAGRAPHS * 5}</article></body></html>", "\n".join(SENTENCES * 5)),
    "text with br": (f"<html><body><div>{'<br><br>'.join(SENTENCES)}</div></body></html>", " ".join(SENTENCES)),
    "text with br in the body": (f"<html><body>{'<br><br>'.join(SENTENCES)}</body></html>", " ".join(SENTENCES)),
    "no body": (PARAGRAPHS, LINES),
    "plain text": (SENTENCES[0], SENTENCES[0]),
    "text after an element": (f"<p>{SENTENCES[0]}</p> {SENTENCES[1]}", f"{SENTENCES[0]}\n{SENTENCES[1]}"),
    "text after the body": (f"<html><body><p>{SENTENCES[0]}</p></body></html>\n{SENTENCES[1]}", f"{SENTENCES[0]}\n{SENTENCES[1]}"),
    "columns": (
        f'<html><head><title>x</title></head><body><div class="header"><ul><li><a href="/">Home</a></li><li><a href="/c">Contact</a></li></ul></div><div class="row"><div class="col-8"><h2>Title of it</h2>{PARAGRAPHS}</div>'
        '<div class="col-4 sidebar"><h3>Related</h3><ul><li><a href="/1">Some other story</a></li><li><a href="/2">And another one</a></li></ul></div></div><div class="footer"><p>Copyright 2024</p></div></body></html>',
        f"Title of it\n{LINES}",
    ),
    "comments": (f'<html><body><div>{PARAGRAPHS}</div><div class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I liked this story a lot, thank you for it.</p></div></div></body></html>', LINES),
    "lists": (f"<html><body><h1>Things</h1><p>{SENTENCES[0]}</p><ul><li>{SENTENCES[1]}</li><li>{SENTENCES[2]}</li></ul><p>{SENTENCES[3]}</p></body></html>", "Things\n" + "\n".join(SENTENCES[:4])),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_articles_in_every_layout(trees, name):
    source, text = LAYOUTS[name]
    assert htmlmain.extract([source], trees) == [text]


def test_pages_of_the_table(trees):
    """Every page of the table has an article element, and its blocks are the text."""
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        article = htmlmain.Page("<article>" + r["html"].split("<article>")[1].split("</article>")[0])
        assert htmlmain.extract([r["html"]], trees) == [htmlmain.text_of(article, np.ones(len(article.tag), bool))]


def test_decoding_is_hierarchical():
    page = htmlmain.Page("<html><body><div><p>a<span>b</span></p><div><p>c</p></div></div><p>d</p></body></html>")
    assert page.tag == ["html", "body", "div", "p", "span", "div", "p", "p"]
    inside = htmlmain.decode(page, np.array([0.1, 0.1, 0.9, 0.9, 0.8, 0.01, 0.7, 0.1]))
    # the inner paragraph is likely, but not as likely as its container is not
    assert inside.tolist() == [False, False, True, True, True, False, False, False]
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = rng.uniform(0.01, 0.99, 8)
        got = htmlmain.decode(page, p)
        assert score(page, p, got) == pytest.approx(max(score(page, p, np.array([(m >> i) & 1 for i in range(8)], bool)) for m in range(256)))


def score(page, p, inside):
    """Log-probability of a choice; minus infinity if an element is inside again under one that was cut out."""
    for i, q in enumerate(page.parent):
        if inside[i] and q >= 0 and not inside[q]:
            while q >= 0:
                if inside[q]:
                    return -np.inf
                q = page.parent[q]
    return np.log(np.where(inside, p, 1 - p)).sum()


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    forest = boosting.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert ((forest.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_query_form_and_odd_pages(spark, trees):
    odd = [PAGE, None, "", "just words", "<", "<p", "</p></div>", "<a href='x", "<div>" * 3000 + "x", PAGE.replace("</article>", "").replace("</body></html>", ""), "<script>alert(1)"]
    df = spark.createDataFrame([(i, "u", h, "clash", 5) for i, h in enumerate(odd)], "page_id long, url string, html string, text string, n_chars int")
    rows = {r.page_id: r for r in htmlmain.main_text(df, trees=trees).collect()}
    assert len(rows) == len(odd) and rows[0].text == htmlmain.extract([PAGE], trees)[0]
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert rows[1].text == rows[2].text == rows[10].text == ""
    assert htmlmain.main_text(df.limit(0), trees=trees).count() == 0


def plain_tree(source):
    """The elements of well-formed markup by the standard library's parser, as nested lists [tag, attributes, children]."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.top = ["", {}, []]
            self.open = [self.top]

        def handle_starttag(self, tag, attrs):
            node = [tag, dict(attrs), []]
            self.open[-1][2].append(node)
            if tag not in htmlmain.VOID:
                self.open.append(node)

        def handle_endtag(self, tag):
            while len(self.open) > 1 and self.open.pop()[0] != tag:
                pass

        def handle_data(self, data):
            self.open[-1][2].append(data)

    reader = Reader()
    reader.feed(source)
    reader.close()
    return reader.top


def plain_text(node, inside, blocks):
    """Blocks of the text below the elements that ``inside`` takes, walked one node after another."""
    for child in node[2]:
        if isinstance(child, str):
            if inside(node):
                blocks[-1].append(child)
            continue
        edge = child[0] in htmlmain.BLOCK
        if edge:
            blocks.append([])
        elif child[0] == "br" and inside(node):
            blocks[-1].append(" ")
        plain_text(child, inside, blocks)
        if edge and child[0] not in htmlmain.VOID:
            blocks.append([])


def test_texts_equal_a_plain_walk_of_the_tree(trees):
    """Made-up pages with every element closed: what decoding takes comes out as a walk of another parser's tree gives it."""
    import re

    maker, seen = htmlmain._Maker(77), 0
    for _ in range(120):
        source = maker.page()
        if re.search(r"<p data-y=\"\d\">(?:(?!</p>|<p).)*(?:<p|<div|<ul|<h\d|<table|<section|<figure|<pre|<blockquote|<aside|<nav|<form|<header|<footer|<ol|$)", source) or not source.endswith("</html>") or "<b data-y" in source:
            continue
        page = htmlmain.Page(source)
        inside = htmlmain.decode(page, trees.probability(htmlmain.features([page])))
        marks = iter(inside.tolist())
        tree, states = plain_tree(source), {}

        def number(node):
            for child in node[2]:
                if not isinstance(child, str):
                    states[id(child)] = next(marks)
                    number(child)

        number(tree)
        blocks = [[]]
        plain_text(tree, lambda node: states.get(id(node), False), blocks)
        want = "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))
        assert htmlmain.text_of(page, inside) == want
        seen += 1
    assert seen > 10


@pytest.mark.parametrize("part", ["<a ", "<div>", "<b><hr>", '<b ">" ', "<p>a", "<ul><li>x", "<!--x", "</x>", "<", "<b '\">"])
def test_time_follows_the_length_of_hostile_pages(part):
    import time

    def took(n):
        source = part * (n // len(part)) + ">"
        begun = time.process_time()
        htmlmain.Page(source)
        return time.process_time() - begun

    took(1000)
    assert took(800_000) < 12 * took(200_000) + 0.5


def test_a_very_long_page_and_repeated_rows(spark, trees):
    paragraphs = [f"Sentence {i}, which is part of a very long article, has some words." for i in range(30_000)]
    long = f"<html><body><nav><a href='/a'>menu</a></nav><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article></body></html>"
    df = spark.createDataFrame([(1, "u", long), (2, "u", PAGE), (2, "u", PAGE), (None, None, PAGE)], "page_id long, url string, html string")
    rows = htmlmain.main_text(df, trees=trees).collect()
    assert next(r.text for r in rows if r.page_id == 1) == "\n".join(paragraphs)
    assert len(rows) == 4 and len({r.text for r in rows if r.page_id != 1}) == 1
