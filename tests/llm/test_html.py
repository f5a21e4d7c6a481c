from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provframe.llm import html_extract
from provframe.llm.html_extract import Page, Tree, folded, main_text, merged, own_blocks, tree_matching

SCHEMA = "page_id long, url string, html string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a><li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="layout sidebar"><article class="post"><header><h1>The &amp;  title</h1></header>
<p>One <b>bold</b>&nbsp;text<br>more<p>Two<script>x</script> words &lt;tag&gt; &#233;<div class=ad>Buy</div><span class="share">Share</span>
<form>Your mail <input name=x></form><ul><li>first<li>second</ul><blockquote>Quote</blockquote><!-- no --></article>
<aside>Side</aside><section id="comments"><article class="comment"><p>I think</p></article></section></div><footer>End</footer></body></html>"""


def test_parts_of_a_page():
    assert main_text(Page(PAGE)).split("\n") == ["The & title", "One bold text more", "Two words <tag> é", "first", "second", "Quote"]


@pytest.mark.parametrize("source", ["", "plain text", "<p", "<<>>", "<p>a<p>b</p></p></div>", "<b>" * 20_000, "<div>" * 20_000 + "x", "<!-- open", "<script>open", '<a href="x', "&#0; &bogus; &amp", "<p>" + "x " * 200_000])
def test_any_source_is_read(source):
    text = main_text(Page(source))
    nodes, place = folded(Page(source))
    assert text == text.strip() and len(place) == len(Page(source).labels) and nodes[0]
    assert merged(nodes, nodes) == nodes and len(tree_matching(Tree(nodes), Tree(nodes))) == len(nodes[0])


def nodes_of(*nodes):
    return [p for p, _ in nodes], [label for _, label in nodes]


def tree(*nodes):
    return Tree(nodes_of(*nodes))


def test_tree_matching_keeps_order_and_ancestors():
    a = tree((-1, "#"), (0, "a"), (0, "b"), (2, "c"), (0, "d"))
    b = tree((-1, "#"), (0, "d"), (0, "b"), (2, "c"), (2, "e"), (0, "a"))
    assert sorted(tree_matching(a, b)) == [(0, 0), (2, 2), (3, 3)]


@st.composite
def random_tree(draw):
    labels = draw(st.lists(st.sampled_from("abc"), max_size=7))
    parents, path = [-1], [0]
    for k in range(1, len(labels) + 1):  # a parent on the path to the node before keeps document order
        parent = draw(st.sampled_from(path))
        path = path[: path.index(parent) + 1] + [k]
        parents.append(parent)
    return parents, ["#", *labels]


def most_pairs(a, b, x=0, y=0):
    """Size of the best matching, by trying every way to pair children in order."""
    def best(left, right):
        if not left or not right:
            return 0
        found = max(best(left[1:], right), best(left, right[1:]))
        if a.labels[left[0]] == b.labels[right[0]]:
            found = max(found, most_pairs(a, b, left[0], right[0]) + best(left[1:], right[1:]))
        return found

    return 1 + best(a.children[x], b.children[y])


@settings(max_examples=150, deadline=None)
@given(random_tree(), random_tree())
def test_matching_is_largest_and_merging_keeps_all_nodes(one, two):
    a, b = Tree(one), Tree(two)
    pairs = tree_matching(a, b)
    assert len(pairs) == len(set(pairs)) == most_pairs(a, b)
    assert all((a.parents[x], b.parents[y]) in pairs for x, y in pairs if x)
    whole = merged(one, two)
    assert len(whole[1]) == len(one[1]) + len(two[1]) - len(pairs)
    for part in (a, b):
        assert most_pairs(part, Tree(whole)) == len(part.labels)  # the merged tree holds both, in order
    assert all(p < k for k, p in enumerate(whole[0]))


def test_long_sibling_lists_are_matched_in_one_pass(monkeypatch):
    monkeypatch.setattr(html_extract, "SIBLING_PAIRS", 3)
    a, b = tree((-1, "#"), (0, "p"), (0, "h"), (0, "p")), tree((-1, "#"), (0, "h"), (0, "p"), (0, "h"))
    assert sorted(tree_matching(a, b)) == [(0, 0), (1, 2), (2, 3)]


def test_matching_does_not_depend_on_the_length_of_sibling_lists(monkeypatch):
    """A first sibling whose only like is the last on the other side must not cost all others their partners."""
    k = 600
    a, b = tree((-1, "#"), (0, "z"), *[(0, "xp"[i % 2]) for i in range(k)]), tree((-1, "#"), *[(0, "xp"[i % 2]) for i in range(k)], (0, "z"))
    assert k * k > html_extract.SIBLING_PAIRS
    found = sorted(tree_matching(a, b))
    assert found == [(0, 0)] + [(i + 2, i + 1) for i in range(k)]
    monkeypatch.setattr(html_extract, "SIBLING_PAIRS", 1)
    assert sorted(tree_matching(a, b)) == found


def test_constant_nodes_are_template_and_slots_are_content(spark):
    page = "<html><body><div id=top>Daily news of the town</div><div class=story><h2>Title {k}</h2><p>Text {k} of the story</p></div><div class=tail>All rights kept</div></body></html>"
    rows = [(k, "http://a.example/x", page.format(k=k)) for k in range(12)] + [(50, "http://b.example/", page.format(k=0)), (51, None, None), (52, "nonsense", "")]
    rows += [rows[0], (None, "http://a.example/", page.format(k=99))]
    found = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[3] == "Title 3\nText 3 of the story" and by_id[None] == "Title 99\nText 99 of the story"
    assert by_id[50].startswith("Daily news") and by_id[51] == by_id[52] == ""
    assert all(r.n_chars == len(r.text) for r in found)


def test_empty_table(spark):
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_given_pages_have_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_extract.extracted(pages).collect()}
    for r in pages.collect():
        lines = found[r.page_id].text.split("\n")
        title = main_text(Page(r.html)).split("\n")[0]
        assert lines[0] == title and "&copy;" not in lines[-1] and len(lines) > 1
        assert found[r.page_id].text == main_text(Page(r.html))


def test_names_of_parts_of_an_article_do_not_drop_them():
    page = """<body><article><h1>T</h1><section id="discussion"><p>We discuss</p></section><h2 id="related-work">Related</h2><h2 id="search">Search</h2>
<h2 id="ad-hoc-queries">Ad hoc</h2><p class="notice">Note</p><p class="share-of-voice">Voice</p><div class="box ad">Buy</div></article><div id="related-work">More pages</div></body>"""
    assert main_text(Page(page)).split("\n") == ["T", "We discuss", "Related", "Search", "Ad hoc", "Note", "Voice"]


def test_no_single_page_decides_on_the_template(spark):
    """The first page is empty or has an older layout; both layouts have notices of their own."""
    new = "<body><div class=box>Now with a new look for all</div><div class=story><h2>Title {k}</h2><p>Text {k} of a rather long story</p></div></body>"
    old = "<body><div><div class=box>The old look of this town</div></div><table><tr><td>Old title {k} and its long text</table></body>"
    pages = [None, ""] + [old] * 20 + [new] * 20
    rows = [(k, f"http://a.example/{k}", page and page.format(k=k)) for k, page in enumerate(pages)]
    found = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == found[1] == ""
    assert all(found[k] == f"Old title {k} and its long text" for k in range(2, 22))
    assert all(found[k] == f"Title {k}\nText {k} of a rather long story" for k in range(22, 42))


@pytest.mark.parametrize("advert", ["Ad {k}", "A rotating advert number {k} longer than the title"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_copies_of_one_article_keep_their_text(spark, tag, advert):
    page = f"<body><{tag}><h1>The title</h1><p>A long text that all the mirrors of this page have in common, and nothing else</p></{tag}><div class=stamp>{advert}</div></body>"
    rows = [(k, "http://a.example/", page.format(k=k)) for k in range(12)]
    found = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("The title\nA long text that all the mirrors of this page have in common, and nothing else" in r.text for r in found)


def rows_of(page, count, host="http://a.example/"):
    return [(k, host, page.format(k=k)) for k in range(count)]


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_siblings_with_equal_paths_are_told_apart_by_order(spark):
    """The first paragraph is the same on all pages, the last one is not; both have the same path, and some pages have more around."""
    page = "<body><p>Welcome to the town</p><div>Story {k} and all that happened on this day</div>{more}<p>Written by {k}</p></body>"
    rows = [(k, "http://a.example/", page.format(k=k, more="<ul><li>Point {k}</ul>".format(k=k) if k % 3 else "")) for k in range(12)]
    found = texts(spark, rows)
    for k in range(12):
        assert found[k] == "\n".join([f"Story {k} and all that happened on this day", *([f"Point {k}"] if k % 3 else []), f"Written by {k}"])


def test_many_different_trees_of_a_host_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "FAN_IN", 2)
    parts = ["<h2>Head {k} over more</h2>", "<p>Long text of page {k}, the one and only</p>", "<ul><li>Point {k} of a list</ul>", "<pre>Code {k} in a listing</pre>", "<table><tr><td>Cell {k} of a table</table>"]
    rows = []
    for k in range(64):
        own = [part for n, part in enumerate(parts) if k >> n & 1] or [parts[1]]
        rows.append((k, "http://a.example/", ("<body><div id=top>News of the town</div><div class=story>" + "".join(own) + "</div><div id=end>All rights</div></body>").format(k=k)))
    found = texts(spark, rows)
    assert all(text and "News of the town" not in text and "All rights" not in text and str(k) in text for k, text in found.items())


def test_running_text_keeps_its_names_and_formulas(spark):
    page = '<article><h1>T</h1><p>Let <math><mi>x</mi></math> be.</p><p class="share">Share of all</p><ul><li class="ad">Item</ul><div class="ad">Buy</div></article>'
    assert main_text(Page(page)).split("\n") == ["T", "Let x be.", "Share of all", "Item"]


def test_votes_equal_brute_force(spark):
    """Hosts whose pages have one tree each, so that a node is a place in it; copies of a page vote once."""
    page = "<body><div id=top>{top}</div><div class=story><h2>{title}</h2><p>{body}</p></div><section>{tail}</section></body>"
    rows = []
    for k in range(60):
        host = f"http://h{k % 3}.example/"
        top = "Same" if k % 3 == 0 or k % 10 else f"Other {k}"
        rows.append((k, host, page.format(top=top, title=f"Title {k % 7}", body=f"Body {k // 6 * 3 + k % 3} " * 9, tail="Tail" if k % 3 < 2 else k)))
    votes = defaultdict(set)
    for _, host, source in rows:
        own = own_blocks(Page(source))
        for node, text in own:
            longest = max(len(t) for n, t in own if n != node)
            votes[host, node].add((text, tuple(sorted(t for n, t in own if n != node and 4 * len(t) >= longest))))
    constant = set()
    for key, seen in votes.items():
        most = Counter(text for text, _ in seen).most_common(1)[0][1]
        if len(seen) >= html_extract.MIN_PAGES and most >= html_extract.SAME * len(seen):
            constant.add(key)
    assert constant
    found = texts(spark, rows)
    for k, host, source in rows:
        own = own_blocks(Page(source))
        assert found[k] == "\n".join(text for node, text in own if (host, node) not in constant)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, host long, tree string"
    rows = [(1, "http://a/", "<p>x</p>", None, 1, "t"), (1, "http://a/", "<p>x</p>", None, 1, "t"), (None, None, None, None, None, None), (2, "", "", "", 0, "")]
    rows += [(3, "http://a/", "<div>" * 3000 + "deep", None, None, None), (4, "http://a/", "<p>" + "word " * 100_000, None, None, None)]
    found = sorted((str(r.page_id), r.n_chars) for r in html_extract.extracted(spark.createDataFrame(rows, schema)).collect())
    assert found == [("1", 1), ("1", 1), ("2", 0), ("3", 4), ("4", 499_999), ("None", 0)]
