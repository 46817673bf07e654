"""Page text: markup cases, and templates that only show across the pages of a host."""

import itertools

from strandframe.llm import wrapper

SCHEMA = "page_id long, url string, html string, text string"


def text(page: str) -> str:
    return wrapper.main_text(page, None, frozenset())


def test_what_is_left_out():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>H</header>
    <nav><ul><li><a href="/x">menu</a></ul></nav><div class="cookie-notice">C</div><!-- <p>no</p> --><div class="ad">A</div>
    <article><h1>Head &amp; line</h1><p><b>One</b>two <i>three</i><br>four<p>five&nbsp;six<aside>S</aside><form>F</form>
    <div id="comments"><p>C</p></div></article><div class="sidebar">B</div><footer>&copy; F</footer></body></html>"""
    assert text(page) == "Head & line Onetwo three four five six"


def test_lenient_and_odd_pages():
    assert text("") == text("   ") == text("<p></p>") == ""
    assert text("plain a < b") == "plain a < b"
    assert text("<article><p>cut &amp; off <b>he") == "cut & off he"
    assert text("<article><p>cut</p><p>of</p") == "cut of"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a b c d e"
    assert text("<body><p>main</p><p hidden>h</p><div role=navigation>n</div></body>") == "main"
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def brute_matching(a, b) -> int:
    """Size of the largest order-preserving matching of two forests, by trying all choices."""
    if not a or not b:
        return 0
    best = 0
    for n in range(min(len(a), len(b)) + 1):
        for x in itertools.combinations(range(len(a)), n):
            for y in itertools.combinations(range(len(b)), n):
                if all(a[i][0] == b[j][0] for i, j in zip(x, y)):
                    best = max(best, sum(1 + brute_matching(a[i][1], b[j][1]) for i, j in zip(x, y)))
    return best


def test_simple_tree_matching():
    leaf = lambda *tags: [(t, []) for t in tags]
    forests = [leaf("p", "q", "p"), [("d", leaf("p", "q")), ("p", [])], [("d", leaf("q")), ("d", leaf("p", "q", "q")), ("q", [])], [], leaf("q")]
    for a, b in itertools.product(forests, repeat=2):
        size, pairs = wrapper.matching(a, b)
        assert size == brute_matching(a, b)
        assert all(a[i][0] == b[j][0] for i, j in pairs) and pairs == sorted(pairs)


def test_template_of_a_host(spark):
    page = lambda i: f"<html><body><div><p>Welcome to our site</p></div><section><h2>Story {i}</h2><p>Text of {i}.</p></section><div><p>All about us</p></div></body></html>"
    rows = [(i, f"http://host.example/{i}", page(i), "clash") for i in range(12)]
    rows += [(20, "https://other.example/a", "<article>x</article>", ""), (21, None, None, ""), (None, "http://host.example/n", "", ""), (20, "https://other.example/a", "<article>x</article>", "")]
    got = wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    found = {r.page_id: (r.text, r.n_chars) for r in got}
    assert all(found[i][0] == f"Story {i} Text of {i}." for i in range(12))
    assert found[20] == ("x", 1) and found[21] == ("", 0) and found[None] == ("", 0)
    assert wrapper.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_template_inside_an_article(spark):
    notice = "<p>Read our terms first.</p>"
    page = lambda i: f"<html><body><article><h1>Head {i}</h1>{notice}<p>Text of {i}.</p><p>More of {i}.</p><div><b>Buy</b> now</div></article></body></html>"
    rows = [(i, f"http://host.example/{i}", page(i), "") for i in range(12)]
    got = wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Head {i} Text of {i}. More of {i}." for i in range(12)}


def test_copies_are_no_template(spark):
    plain = lambda i, at: f"<html><body><div><p>Welcome</p></div><section><h2>Story {i}</h2><p>Text of {i}.</p></section><footer>{at}</footer></body></html>"
    held = lambda i, at: f"<html><body><p>{at}</p><article><h2>Story {i}</h2><p>Text of {i}.</p></article></body></html>"
    rows = [(i, "http://copies.example/", plain(min(i, 2), 0), "") for i in range(12)]
    rows += [(20 + i, "http://footers.example/", plain(min(i, 2), i), "") for i in range(12)]
    rows += [(40 + i, "http://held.example/", held(min(i, 2), i), "") for i in range(12)]
    found = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(12):
        assert found[i].endswith(f"Story {min(i, 2)} Text of {min(i, 2)}.") and found[20 + i] == found[i]
        assert found[40 + i] == f"Story {min(i, 2)} Text of {min(i, 2)}."


def test_class_words_of_a_layout():
    assert text("<div class='layout has-sidebar'><article>all of it</article></div>") == "all of it"
    assert text("<div class='layout has-sidebar'><p>all of it</p><div class=sidebar>S</div></div><div class=ad>A</div>") == "all of it"
    assert text("<main><h1>H</h1><div class='page with-header'><p>a long text</p><div class=share>x</div></div></main>") == "H a long text"
    assert text("<div class='post comments-open'><p>all of it</p></div>") == "all of it"
    assert text("<article>the whole story</article><div class=related><article>teaser</article></div>") == "the whole story"
    assert text("<article>short</article><div class=has-sidebar><article>the whole story</article></div>") == "short the whole story"
    assert text("<article><p>a</p><div id=comments>much longer words of readers</div></article>") == "a"
