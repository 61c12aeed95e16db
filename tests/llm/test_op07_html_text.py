import random

import pytest

from fringeworks.llm import op07_html_text as op


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, hashes string")
    return {r.page_id: (r.text, r.n_chars) for r in op.extracted(df).collect()}


def page(i, url, html):
    return (i, url, html, "x", "y")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>T</h1><p>a  b\n c<br>d &amp; &lt;e&gt; &eacute;&#233;&nbsp;f</p></article><footer>z</footer>", "T a b c d & <e> éé f"),
        ("<nav>m<nav>n</nav></nav><main><div>x <b>y</b>z</div><aside>s</aside><form>f</form></main>", "x yz"),
        ("<article><p>a<p class='ad'>buy<p>b<div id=comments><p>nice</div><script>var t='</p>';</script>c</article>", "a b c"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<!-- <p>no</p> --><article>yes<!-- open", "yes"),
        ("<header>h</header><article><section>1</section><section>2</section></article><div class='cookie-notice'>ok?</div>", "1 2"),
        ("<article></article>", ""),
        ("", ""),
        (None, ""),
        ("<p>only a paragraph", "only a paragraph"),
        ("plain < text", "plain < text"),
        ("<article><p title='a > b'>q</p><img src=x>r</article>", "q r"),
    ],
)
def test_structure(spark, html, want):
    assert texts(spark, [page(1, "http://h/p", html)])[1] == (want, len(want))


def test_shared_lines_of_the_nearest_page_go_where_nothing_is_marked(spark):
    shell = "<body><div>Home</div><div>About us</div>{}<div>All rights</div></body>"
    rows = [page(1, "http://h/news/1", shell.format("<p>one</p>")), page(2, "http://h/news/2?x=1", shell.format("<p>two</p>")), page(3, "http://h/zzz", "<p>Home</p><p>far</p>"), page(4, "http://other/news/1", shell.format("<p>alone</p>")), page(5, "http://h/news/2#top", shell.format("<p>two again</p>"))]
    got = {k: v[0] for k, v in texts(spark, rows).items()}
    assert got == {1: "one", 2: "two", 3: "far", 4: "Home About us alone All rights", 5: "two again"}


def test_marked_articles_are_never_differenced(spark):
    a = "<article><p>same text</p></article>"
    assert {v[0] for v in texts(spark, [page(i, f"http://h/{i}", a) for i in range(5)]).values()} == {"same text"}


def test_null_and_odd_urls_repeats_and_empty(spark):
    rows = [page(1, None, "<p>a</p>"), page(1, None, "<p>a</p>"), page(2, "not a url", "<p>b</p>"), page(None, "http://h/x", "<article>c</article>")]
    assert texts(spark, rows) == {1: ("a", 1), 2: ("b", 1), None: ("c", 1)}
    assert op.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        at = op.common_lines(a, b)
        assert len(at) == row[-1][-1] and at == sorted(set(at))
        it = iter(b)
        assert all(a[i] in it for i in at)


def test_many_equal_lines_are_aligned_as_exactly(monkeypatch):
    """One line nine times in ten: places are too many to list, bit vectors find as long a subsequence."""
    rnd = random.Random(4)
    for n, listed in ((700, None), (60, 5), (33, 0)):
        if listed is not None:
            monkeypatch.setattr(op, "LISTED", listed)
        a, b = ([0 if rnd.random() < 0.9 else rnd.randrange(1, 40) for _ in range(n)] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        at = op.common_lines(a, b)
        it = iter(b)
        assert len(at) == row[-1] and at == sorted(set(at)) and all(a[i] in it for i in at)


def test_which_rule_takes_a_block(spark):
    html = "<nav><p>menu</p><p>{0}</p></nav><div>shared</div><article><p>{0}</p><p>quote</p></article><div>odd {0}</div>"
    df = spark.createDataFrame([page(i, f"http://h/{i}", html.format(w)) for i, w in enumerate("ab")], "page_id long, url string, html string, lines string, hashes string")
    for r in op.extracted(df).collect():
        w = "ab"[r.page_id]
        assert (r.text, r.n_differenced, r.n_by_markup, r.n_vetoed) == (f"{w} quote", 2, 2, 1)


def test_differencing_takes_blocks_of_the_given_pages(spark, sf_dir):
    r = op.query(spark, sf_dir).agg({"n_differenced": "sum", "n_by_markup": "sum"}).first()
    assert r[0] > 0 and r[1] > 0


def test_query_gives_each_article(spark, sf_dir):
    """The words of an article are those of the document it was made of, after its heading."""
    docs = {" ".join((r.text or "").split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op.query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    bodies = 0
    for r in rows:
        assert r.n_chars == len(r.text)
        words = r.text.split(" ")
        bodies += any(" ".join(words[k:]) in docs for k in range(1, min(len(words), 40)))
    assert bodies >= 0.8 * len(rows)


def test_very_long_pages(spark):
    """Thirty thousand blocks, nine in ten of them alike on both pages of a host."""
    html = lambda w: "<body>" + "".join(f"<p>{'same' if k % 10 else f'{w} {k}'}</p>" for k in range(30_000)) + "</body>"
    got = texts(spark, [page(1, "http://h/a", html("one")), page(2, "http://h/b", html("two"))])
    assert got[1][0] == " ".join(f"one {k}" for k in range(0, 30_000, 10)) and got[2][0].startswith("two 0 two 10 ")


def test_what_an_article_is_about_is_no_boilerplate():
    """Ids made from headings and odd classes on text tags keep their text; whole names of boilerplate do not."""
    page = """<html><body><article><h2 id="search">On search</h2><p class="related-work">Work of others.</p>
<section id="comments-on-method"><p>Remarks.</p></section><h2 id="copyright">Who owns it</h2><label>A label</label><ul><li id="menu">First item</li></ul>
<p class="advert">Buy now</p><section id="comments"><p>First!</p></section><div class="share-bar">Tell others</div><form><label>Name</label></form></article>
<p class="cookie-notice">We use cookies</p><nav><p>Menu</p></nav></body></html>"""
    texts, kinds, marked = op.blocks(page)
    kept = [t for t, k in zip(texts, kinds, strict=True) if k == op.ARTICLE]
    assert marked and kept == ["On search", "Work of others.", "Remarks.", "Who owns it", "A label", "First item"]
    assert [t for t, k in zip(texts, kinds, strict=True) if k != op.ARTICLE] == ["Buy now", "First!", "Tell others", "Name", "We use cookies", "Menu"]
