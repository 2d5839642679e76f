import pytest

from ripplegraph.llm.html import Page, extract

ARTICLES = [
    ("<article><h1>A &amp; B</h1><p><b>One  two<br>three<p>four</article><footer>x</footer>", "A & B One two three four"),
    ("<nav>menu</nav><article>a<b>b</b>c <i>d</i></article>", "abc d"),
    ('<article><p>keep</p><div class="ad">buy</div><aside>side</aside><form>f<input></form><section id="comments"><p>me</p></section><p>too</p></article>', "keep too"),
    ('<article><header><h1>T</h1></header><script>var t="</p>";</script><style>p{}</style><!-- c > --><p>x &lt; y &copy;&nbsp;z</p></article>', "T x < y © z"),
    ('<body class="has-sidebar"><main><p>m</p><div class="site-footer">no</div></main></body>', "m"),
    ("<article><p>cut of", "cut of"),
    ("<article><p>cut <a href='x", "cut"),
    ("<article><p>1 < 2 and 3 > 2</p>&amp</article>", "1 < 2 and 3 > 2 &"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<article>one</article><article class='comment'>no</article><article>two</article>", "one two"),
    ("<article></article>", ""),
]


@pytest.mark.parametrize("source,text", ARTICLES)
def test_marked_articles(source, text):
    assert Page(source).article() == text


def test_no_article_is_marked():
    assert Page("<p>a</p>").article() is None
    assert Page("").article() is None and Page(None).article() is None


MARKED_INSIDE = [
    ("<main><h2>site</h2><article><h1>T</h1><p>text</p></article></main>", "T text"),
    ("<div role='main'><p>more</p><article><p>text</p></article></div>", "text"),
    ("<div role=main><p>text</p></div><p>other</p>", "text"),
    ("<main><p>text</p></main><aside><article>card</article></aside>", "text"),
    ("<main><p>text</p><div class='comments'><article>me</article></div></main>", "text"),
    ("<main><p>text</p><article></article></main>", "text"),
    ("<p>text</p><aside><article>card</article></aside>", None),
    ("<p>text</p><article></article><main></main>", None),
]


@pytest.mark.parametrize("source,text", MARKED_INSIDE)
def test_article_inside_main_and_articles_left_out(source, text):
    assert Page(source).article() == text


def test_pages_with_articles_left_out_reach_the_template(spark):
    rows = [(1, "http://h.example/1", "<p>text</p><aside><article>card</article></aside>")]
    assert [r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["text"]


def test_template_of_a_host(spark):
    page = "<html><body><div><b>Our site</b></div><div><p>All rights</p></div><div><p>Call us</p></div><div class=x><p>story {0} of it</p><p>and {0} more</p></div></body></html>"
    rows = [(i, "http://h.example/%d" % i, page.format(f"w{i}"), "q") for i in range(6)]
    rows += [(10, "http://h.example/0", page.format("w0"), "q")] * 20
    rows += [(20, "http://other.example/", page.format("z"), "q"), (21, None, None, "q"), (None, "u", "", "q"), (22, "http://h.example/a", "<article>kept</article>", "q")]
    out = {(r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    want = {(i, f"story w{i} of it and w{i} more") for i in range(6)} | {(10, "story w0 of it and w0 more"), (20, "Our site All rights Call us story z of it and z more"), (21, ""), (None, ""), (22, "kept")}
    assert out == {(i, t, len(t)) for i, t in want}


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_hostile_pages_take_linear_time():
    import time

    assert Page("<div>" * 500 + "<article><p>deep</p></article>").article() == "deep"
    n = 80_000
    sources = ["<i>x</b>" * n, "<b><div>" + "<i>x</b>" * n, "<i>" * n + "<li>x" * n, "<div>" * n + "<p>x", "<p>x</div>" * n, "<![CDATA[x" * n]
    for source in sources:
        began = time.process_time()
        Page(source)
        assert time.process_time() - began < 5


@pytest.mark.parametrize("source", ["<div>a<b>b</div>c</b>d", "<b><p>x</b>y</p>z", "<ul><li><b>a<li>b</b></ul>c", "<p><a href=x>l<div>m</a>n</div>"])
def test_misnested_tags_keep_all_words(source):
    import re

    assert "".join(b[2] for b in Page(source).blocks).replace(" ", "") == re.sub("<[^>]*>", "", source)


def brute_template(pages):
    """Class deduction page by page: tokens with equal vectors of counts over distinct pages, three at least, on half of the pages."""
    from collections import Counter, defaultdict

    counts = [Counter(dict(Page(p).tokens())) for p in dict.fromkeys(pages)]
    classes = defaultdict(list)
    for t in set().union(*counts):
        classes[tuple(c[t] for c in counts)].append(t)
    return {t for v, ts in classes.items() if len(ts) >= 3 and sum(n > 0 for n in v) >= max(3, len(counts) / 2) for t in ts}


def test_same_template_as_page_by_page(spark):
    import random

    from ripplegraph.llm.html import read_pages, templates

    draw = random.Random(4)
    parts = ["<div><b>logo</b><p>top</p></div>", "<div><p>contact</p><p>terms</p><p>about</p></div>", "<table><tr><td>a<td>b</table>"]
    pages = ["".join(draw.sample(parts, draw.randrange(1, 4))) + f"<p>story {draw.randrange(12)}</p><p>end {draw.randrange(3)}</p>" for _ in range(30)]
    read = read_pages(spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))
    assert {r.t for r in templates(read).collect()} == brute_template(pages)


FRAME = "<div><b>Our site</b><p>Welcome</p></div><div>{0}</div><div><h2>More</h2>{1}<h3>End</h3></div>"


def nested_hosts():
    """Pages of hosts without marked articles, each with its text."""
    from itertools import permutations

    rows = []
    # the same texts are template in one slot and text in another
    for i in range(8):
        said = [f"story {i}", *["News"] * (i % 2), *["Home"] * (i % 3 == 0), *["Sport"] * (i % 4 == 0)]
        rows.append(("role.example", FRAME.format("".join(f"<p>{x}</p>" for x in said), "<p>Home</p><p>News</p><p>Sport</p>"), " ".join(said)))
    # texts of all pages that come in any order are no class
    for order in permutations(["one thing", "two things", "three things"]):
        rows.append(("order.example", FRAME.format("".join(f"<p>{x}</p>" for x in order), ""), " ".join(order)))
    # a class needs half of its parent's pages: 12 of 20 have the parent, 7 of these the class inside
    for i in range(20):
        inside = "<table><tr><td>Tags<td>Date<td>Author</table>" * (i < 7)
        rows.append(("kind.example", FRAME.format(f"<p>story {i}</p>", f"<ul><li>Follow<li>us{inside}<li>here</ul>" * (i < 12)), f"story {i}"))
    # three tokens that cross a class of more pages on one page are no class
    for i in range(10):
        own = ["Next", "Last", "First"] * (i < 8)
        said = ["Our", "Next", "site", "Last", "again", "First"] if i == 0 else ["Our", "site", "again", *own]
        rows.append(("cross.example", "".join(f"<p>{x}</p>" for x in [*said, f"story {i}"]), " ".join([*own, f"story {i}"])))
    # a class spread over slots of another one counts in all of them, however few of its tokens lie in each
    for i in range(8):
        kind = ["Follow us", "Rights reserved", "Call us"] if i < 6 else [f"story {i} a", f"story {i} b", f"story {i} c"]
        texts = [kind[0], "Our site", f"story {i}", kind[1], "Contact", kind[2], "Imprint"]
        rows.append(("spread.example", "".join(f"<p>{x}</p>" for x in texts), f"story {i}" if i < 6 else f"{kind[0]} story {i} {kind[1]} {kind[2]}"))
    # a class that repeats, with a class in its slot
    for i in range(6):
        item = "<dl><dt>By<dd>{0}<dd>on<dd>{1}<dd>Like</dl>"
        rows.append(("list.example", "".join(item.format(f"name {i} {k}", f"day {i} {k}") for k in range(i + 1)), " ".join(f"name {i} {k} day {i} {k}" for k in range(i + 1))))
    return rows


def test_templates_are_ordered_and_nested(spark):
    from ripplegraph.llm.html import read_pages, templates

    rows = nested_hosts()
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", source) for i, (host, source, _) in enumerate(rows)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in extract(pages).collect()}
    assert {i: (rows[i][0], out[i]) for i in out} == {i: (host, text) for i, (host, _, text) in enumerate(rows)}
    found = templates(read_pages(pages).where("host = 'kind.example'")).collect()
    slots = {r.slot: r for r in found}
    inside = [r for r in found if r.support == 7]
    assert inside and all(slots[r.within].support == 12 for r in inside)
    assert all(slots[slots[r.within].within].support == 20 for r in inside)


def test_placing_takes_linear_time():
    import random
    import time

    from ripplegraph.llm.html import Placed, _waiting, _disordered, _unordered

    n = 60_000
    tokens = [x % 6 for x in range(n)]
    candidates = [{"within": 0, "t": t, "class": t // 3, "first": t, "support": 3, "place": t % 3, "size": 3, "slot": t + 1, "level": 1} for t in range(6)]
    began = time.process_time()
    page = Placed(tokens, [])
    assert list(_unordered(page, candidates, 0)) == [] and list(_waiting(page, candidates, 0)) == []
    assert all(Placed(tokens, candidates).covered)
    nested = list(range(n)) + list(range(n))[::-1]
    assert list(_waiting(Placed(nested, []), [{"within": 0, "t": t, "class": t, "support": 3, "place": 0, "size": 1} for t in range(n)], 0)) == []
    _disordered(random.Random(1).sample(range(n), n))
    assert _disordered([1, 2, 5, 3, 4]) == [2]
    assert time.process_time() - began < 5
