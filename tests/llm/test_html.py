import html
import random
import re

import pytest

from streamwatch.llm import html_wrappers as hw


def brute(source):
    inner = source.split("<article>", 1)[1].split("</article>", 1)[0]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_pages_against_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in hw.extract_pages(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == brute(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def page(body, n=3):
    items = "".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(n))
    return f"<html><body><div class='top-menu'><ul>{items}</ul></div><div class=main><h2>Title</h2>{body}</div><div class='note'>All rights</div><div id=comments><p>me too</p></div></body></html>"


def test_pages_without_article_elements(spark):
    rows = [(i, "http://h.example/x", page(f"<p>First &amp; {i}</p><p>second <b>bo\n ld</b> {i}</p>" + "<p>more %d</p>" % i * (i % 3), 2 + i % 4)) for i in range(12)]
    got = {r.page_id: r.text for r in hw.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows:
        assert got[i].split("\n")[-2 - (i % 3) :] == [f"First & {i}", f"second bo ld {i}"] + [f"more {i}"] * (i % 3)
        assert "m1" not in got[i] and "me too" not in got[i] and "All rights" not in got[i]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no host", "plain text only"), (4, "http://a.b/", "<article><p>x<p>y<script>var a='</p>'</script><form><p>f</p></form></article"), (4, "http://a.b/", "<article><p>x<p>y"), (None, "http://a.b/", "<p>&lt;tag&gt; &nbsp; z <!-- gone --></p>"), (5, "http://C.D:80/q", "<div" + " x" * 5)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted(((r.page_id, r.text) for r in hw.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "plain text only"), (4, "x\ny"), (4, "x\ny"), (None, "<tag> z"), (5, "")], key=str)
    assert hw.extract_pages(df.limit(0)).count() == 0


def tree(s):
    return hw.folded(s)[0]


def merged(*sources):
    out = tree(sources[0])
    for s in sources[1:]:
        hw.merge(out, tree(s))
    return hw.expression(out)


def test_alignment_finds_repeats_and_options():
    a, b = "<div><p>1</p><p>2</p></div>", "<div><h2>t</h2><p>1</p></div>"
    assert hw.expression(tree(a)) == "<div><p>#</p>+</div>"
    assert merged(a, b) == merged(b, a) == "<div><h2>#</h2>?<p>#</p>+</div>"
    assert merged(a, a) == hw.expression(tree(a))
    assert merged("<ul><li>a</ul>", "<ul><li>a<li>b</ul>", "<div>x</div>") == "<ul><li>#</li>+</ul>?<div>#</div>?"
    assert merged("<p>1</p><h2>a</h2><p>2</p><table><tr><td>x</table><p>3</p><hr><h1>z</h1>") == "(<p>#</p>?<h2>#</h2>?<table><tr><td>#</td></tr></table>?)+<h1>#</h1>"


def test_trees_survive_writing():
    for s in ("", "text", "<div><p>1</p><p>2</p><section><h2>a</h2><p>b</p><h2>c</h2></section></div><p>z", "<div>" * 3000 + "x"):
        t = tree(s)
        back = hw.read(hw.written(t))
        assert hw.written(back) == hw.written(t) and back.key == t.key


def test_repeats_are_folded_whatever_their_number():
    assert len({hw.expression(tree(f"<ul>{'<li><a>x</a></li>' * n}</ul>")) for n in (2, 3, 50)}) == 1


def neutral(rng, short, headed):
    """Menu, advert, article and footer in div elements without classes; all texts but menu and heading are in div > p."""
    words = lambda n: " ".join(rng.choice(["tal", "mor", "ven", "sil", "dro"]) + str(rng.randrange(99)) for _ in range(n))
    menu = "".join(f"<li><a href=/{k}>{words(1)}</a></li>" for k in range(rng.randint(3, 6)))
    advert = f"<div><p>{words(25)}</p></div>" if not headed or rng.random() < 0.7 else ""
    article = [words(3 if short else 30) for _ in range(1 if short else rng.randint(2, 5))]
    title = words(4)
    body = (f"<h1>{title}</h1>" if headed else f"<p>{title}</p>") + "".join(f"<p>{a}</p>" for a in article)
    return f"<html><body><div><ul>{menu}</ul></div>{advert}<div>{body}</div><div><p>{words(6)}</p></div></body></html>", "\n".join([title, *article])


@pytest.mark.parametrize("headed", [True, False])
def test_neutral_pages_need_the_whole_wrapper(spark, headed):
    rng = random.Random(3)
    made = [(i, "http://n.example/x", *neutral(rng, i % 7 == 0, headed)) for i in range(60)]
    df = spark.createDataFrame([r[:3] for r in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hw.extract_pages(df).collect()}
    assert got == {i: text for i, _, _, text in made}
    # neither a page alone nor the bare set of the wrapper's paths tells a short article from the advert beside it
    alone = [hw.extract(source) == text for _, _, source, text in made]
    assert not all(alone)
    whole = hw.read(hw.wrappers(df).first()["wrapper"])
    paths = {}
    stack = [(whole, ())]
    while stack:
        node, path = stack.pop()
        paths.setdefault((*path, node.label), []).append(node)
        stack += [(k, (*path, node.label)) for k in node.kids]

    def bare(prefix):
        node = hw.Node(prefix[-1])
        for p in sorted(x for x in paths if len(x) == len(prefix) + 1 and x[: len(prefix)] == prefix):
            node.kids.append(bare(p))
        for n in paths[prefix]:
            node.stats = hw._sum(node.stats, n.stats)
        hw.finish(node)
        return node

    assert headed or not all(hw.extract(source, bare(("",))) == text for _, _, source, text in made)


def test_very_deep_and_very_long_pages(spark):
    deep = "<body>" + "<div>" * 5000 + "<p>down there</p>" + "</div>" * 5000 + "</body>"
    long = "<body><div class=a>" + "<h2>head</h2><p>some words of an article &amp; more</p>" * 200_000 + "</div></body>"
    assert len(long) > 10_000_000
    df = spark.createDataFrame([(1, "http://d.example/", deep), (2, "http://d.example/", long), (3, "http://d.example/", "<div>" * 5000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hw.extract_pages(df).collect()}
    assert got == {1: "down there", 2: "\n".join(["head", "some words of an article & more"] * 200_000), 3: ""}


def test_many_forms_of_a_host_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(hw, "FORMS", 3)
    monkeypatch.setattr(hw, "PAGES", 5)
    marks = ["<h2>s</h2>", "<blockquote>q {i}</blockquote>", "<pre>c {i}</pre>", "<ul><li>l {i}<li>m {i}</ul>", "<h3>t {i}</h3>"]
    rows = []
    for i in range(32):
        inner = "".join(m.format(i=i) for k, m in enumerate(marks) if i >> k & 1)
        rows.append((i, "http://h.example/x", page(f"<p>first {i}</p>{inner}<p>last {i}</p>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert hw.wrappers(df).count() == 1
    got = {r.page_id: r.text for r in hw.extract_pages(df).collect()}
    for i in range(32):
        parts = [p for k, p in enumerate([["s"], [f"q {i}"], [f"c {i}"], [f"l {i}", f"m {i}"], [f"t {i}"]]) if i >> k & 1 for p in p]
        assert [x for x in got[i].split("\n") if x not in ("Title", "s")] == [f"first {i}", *[p for p in parts if p != "s"], f"last {i}"]


def test_copies_of_a_page_are_no_template(spark):
    once = page("<blockquote>only here</blockquote><p>text</p>")
    rows = [(i, "http://h.example/x", once) for i in range(4)] + [(9 + i, "http://h.example/y", page(f"<p>other {i}</p>")) for i in range(4)]
    got = {r.page_id: r.text for r in hw.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "only here\ntext" for i in range(4)) and all(got[9 + i] == f"other {i}" for i in range(4))


def test_article_or_main_is_chosen_on_each_page(spark):
    html_ = lambda i: f"<body><main><h1>head {i}</h1>" + (f"<article><p>in {i}</p></article>" if i % 2 else f"<p>main {i}</p>") + "</main></body>"
    rows = [(i, "http://h.example/x", html_(i)) for i in range(6)] + [(6, "http://h.example/z", "<body><p>neither</p></body>")]
    got = {r.page_id: r.text for r in hw.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"in {i}" if i % 2 else f"head {i}\nmain {i}" for i in range(6)} | {6: "neither"}


ARTICLE = "<article><h1>Title here</h1><p>First paragraph of the story with some words.</p><p>Second one, and it says more than the first.</p></article>"
WHOLE = "Title here\nFirst paragraph of the story with some words.\nSecond one, and it says more than the first."
AROUND = "<nav><a href='/'>Home</a> <a href='/x'>Other</a></nav>{}<aside>Words in the aside</aside><footer>Imprint</footer>"


@pytest.mark.parametrize("outer", ['<div class="site has-sidebar">', '<div class="page no-comments">', '<div class="menu-closed">', '<div id="sidebar">', '<div class="page-header">', '<form action="/post" method="post">'])
def test_what_a_page_is_built_in_is_no_menu(outer):
    tag = outer[1:].split()[0]
    page = f"<html><body>{outer}{AROUND.format(ARTICLE)}</{tag}></body></html>"
    assert hw.extract(page) == WHOLE
    plain = f"<html><body>{outer}{AROUND.format(ARTICLE.replace('article', 'section'))}</{tag}></body></html>"
    assert hw.extract(plain) == WHOLE


def test_names_of_other_words_inside_an_article_stay():
    inside = '<div class="comment-note"><p>A note on a remark.</p></div><div class="related work"><p>What others did on this before.</p></div>'
    page = f"<body>{AROUND.format(ARTICLE.replace('</article>', inside + '</article>'))}</body>"
    assert hw.extract(page) == WHOLE + "\nA note on a remark.\nWhat others did on this before."
    out = '<div class="comments"><p>Nice text, thanks.</p></div><div class="share-buttons"><a href="#">Share it</a></div><div class="related-posts"><a href="/y">Another story</a></div><ul class="related-hub"><li><a href="/z">Linked</a></li></ul>'
    assert hw.extract(f"<body>{AROUND.format(ARTICLE.replace('</article>', out + '</article>'))}</body>") == WHOLE


def test_options_without_an_end_and_formulas():
    listed = '<datalist id="d"><option value="a"><option value="b">B</datalist><select><option>One<option>Two</select><p>after it</p>'
    page = f"<body>{AROUND.format(ARTICLE.replace('</article>', listed + '</article>'))}</body>"
    assert hw.extract(page) == WHOLE + "\nafter it"
    math = "<p>let <math><mi>x</mi><annotation encoding='tex'>x_1</annotation></math> be</p>"
    assert hw.extract(f"<body><article><h1>T</h1>{math}</article></body>") == "T\nlet x be"


def test_alignment_in_linear_space_is_as_good(monkeypatch):
    import random

    rng = random.Random(3)

    def nodes(n):
        out = []
        for _ in range(n):
            node = hw.Node(rng.choice("pqr"))
            node.key, node.has = rng.randrange(6), frozenset(rng.sample("abcdef", 2))
            out.append(node)
        return out

    for _ in range(30):
        a, b = nodes(rng.randrange(1, 30)), nodes(rng.randrange(1, 30))
        worth = lambda pairs: sum(hw.likeness(a[i], b[j]) for i, j in pairs)  # noqa: B023, E731
        whole = hw._best(a, b)
        monkeypatch.setattr(hw, "CELLS", 8)
        parted = hw._best(a, b)
        monkeypatch.undo()
        assert abs(worth(whole) - worth(parted)) < 1e-3 and all(x < y and u < v for (x, u), (y, v) in zip(parted, parted[1:]))
