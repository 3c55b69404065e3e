"""Benchmark passages, web pages and the pipeline."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from cases import LONG, alnum_words, documents, no_documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kerbside.llm import decontam, wrappers
from kerbside.llm.markup import parse
from kerbside.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_scan(words, items, window):
    """Positions hit and items found, by looking up every window."""
    windows = {}
    for name, w in items:
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    hit, found = set(), set()
    for size in {len(k) for k in windows}:
        for i in range(len(words) - size + 1):
            if names := windows.get(tuple(words[i : i + size])):
                hit.update(range(i, i + size))
                found |= names
    return hit, found


@settings(max_examples=300, deadline=None)
@given(items=st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), words=st.lists(st.sampled_from("abcd"), max_size=40), window=st.integers(1, 5))
def test_automaton_equals_lookup(items, words, window):
    named = [(str(i), [w.encode() for w in item]) for i, item in enumerate(items)]
    spans, found = decontam.Automaton([n for n in named if n[1]], window).hits([w.encode() for w in words])
    hit, names = slow_scan(words, [(str(i), item) for i, item in enumerate(items)], window)
    assert {i for a, b in spans for i in range(a, b)} == hit and found == names
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_decontaminate_query(spark):
    items = [(str(r.item_id), alnum_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: alnum_words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_decontaminate"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        hit, found = slow_scan(texts[r.doc_id], items, 10)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(texts[r.doc_id]), len(hit), len(found), digest, bool(hit))


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id int")


def test_spans_leave_the_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    body = "Some words before it. " + item.title().replace(" ", ", ") + "! And some more words after it, enough of them to keep the text as it is."
    docs = spark.createDataFrame([(1, body, 5), (2, item, 5), (3, "clean", 5), (4, None, 5), (5, LONG + " " + item, 5)], "doc_id bigint, text string, n_chars int")
    kept = {r.doc_id: r for r in decontam.decontaminate(docs, benchmark(spark, [(1, item, 0), (2, None, 0), (3, "", 0), (4, "!!", 0)]), length_col="n_chars").collect()}
    assert set(kept) == {1, 3, 4, 5}
    assert kept[1].text == "Some words before it. ! And some more words after it, enough of them to keep the text as it is." and kept[1].n_chars == len(kept[1].text)
    assert kept[3].text == "clean" and kept[3].n_chars == 5 and kept[4].text is None
    assert "kappa" not in kept[5].text and kept[5].text.startswith(LONG)


def test_shards_of_a_large_benchmark(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(random.choices(words, k=random.choice([0, 2, 5, 12, 30]))), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=200)) + " " + items[i][1]) for i in range(30)], "doc_id bigint, text string")
    expected = {i: slow_scan(alnum_words(t), [(str(n), alnum_words(x)) for n, x, _ in items], 4) for i, t in docs.collect()}
    for shard_words in (50, 10**6):
        rows = decontam.scan(docs, benchmark(spark, items), window=4, shard_words=shard_words).collect()
        assert {r.doc_id: ({p for s in r._spans for p in range(s.first, s.end)}, set(r._items)) for r in rows} == expected


def test_scan_edge_cases(spark):
    docs = documents(spark)
    for items in ([], [(1, None, 0), (None, "", 0)]):
        rows = decontam.scan(docs, benchmark(spark, items)).collect()
        assert len(rows) == 15 and not any(r._spans for r in rows)
        assert decontam.decontaminate(docs, benchmark(spark, items)).columns == docs.columns
    rows = decontam.scan(docs, benchmark(spark, [(None, "one two", 0), (7, "one", 0), (7, "one", 0)]), keep=["doc_id"]).collect()
    assert {r.doc_id: r._items for r in rows if r._items} == {5: ["7"], 6: ["", "7"]}
    assert decontam.scan(no_documents(spark), benchmark(spark, [(1, "a", 0)])).count() == 0


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}<style>p{{x:1}}</style><script>var t='</p><p>no';</script></head><body>{body}</body></html>"


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("x"), "c0": F.lit(2)})
    return {r.page_id: r.text for r in wrappers.extract(df).collect()}


def test_boilerplate_goes_and_the_article_stays(spark):
    body = (
        "<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class='ad'>Buy</div><!-- c > --><main><article><header><h1>Head &amp; line</h1><span>by me</span></header>"
        "<p>One <b>bo</b>ld,<br>two&nbsp; three &lt;tag&gt;.<p>Unclosed <i>italic<div class='share-buttons'>Share</div><ul><li>x<li>y</ul><form>f</form><aside>aside</aside>"
        "<div id=comments><p>First!</p></div><div class='cookie-notice'>Cookies</div><table><tr><td>1<td>2</table></article></main><div class=sidebar>s</div><footer>&copy; us</footer>"
    )
    found = texts(spark, [(i, "http://h.example/x", page(body)) for i in range(3)])
    assert set(found.values()) == {"Head & line One bold, two three <tag>. Unclosed italic x y 1 2"}


def test_pages_without_an_article(spark):
    pages = [(i, "http://User@News.example:80/p?q", page(f"<div class=motto>Our motto</div><div class=top><a href=/>Home {i}</a></div><div class=body><h2>Title {i}</h2><p>Text of page {i}.</p>{'<p>More.</p>' * (i % 3)}</div>")) for i in range(9)]
    found = texts(spark, pages)
    assert found[1] == "Title 1 Text of page 1. More." and found[3] == "Title 3 Text of page 3."


def test_page_edge_cases(spark):
    rows = [(1, None, None), (2, "http://a/b", ""), (3, "nonsense", "plain < text & more"), (4, "http://a/c", "<p>x</p>" * 3000), (4, "http://a/c", "<p>x</p>" * 3000), (None, "http://a/d", "<ul><li>1</ul><script>never closed"), (5, "http://a/e", "<div>" * 3000 + "deep")]
    found = texts(spark, rows)
    assert (found[1], found[2], found[3], found[None]) == ("", "", "plain < text & more", "1")
    assert found[4] == " ".join("x" * 3000) and found[5] == "deep"
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert wrappers.extract(df).count() == 0


def test_only_whole_attributes_hide_an_element(spark):
    kept = ['style="overflow:hidden"', 'title="A hidden gem"', 'data-hidden="false"', "title='x class=\"ad\" hidden'", "data-class=sidebar", "aria-hidden=false", "data-aria-hidden=true"]
    for n, attributes in enumerate(kept):
        assert texts(spark, [(1, f"http://h{n}/", f"<body {attributes}><p {attributes}>kept</p></body>")]) == {1: "kept"}
    gone = ["hidden", "HIDDEN=''", "id=x hidden", "aria-hidden='true'", "class='x ad'", "role=navigation"]
    assert all(parse(f"<div {a}>x</div>").children[0].key.endswith("!") for a in gone)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>a</p><svg class="i"/><p>kept text</p></article>', "a kept text"),
        ("<article><p>one<style-guide>two</style-guide></p><p>three</p></article>", "one two three"),
        ("<article><p>a <svg><path d='x'></p><p>b</p></article>", "a b"),
        ("<article><div><object data=x><p>fallback</div><p>b</p></article>", "b"),
        ("<article><template><p>x<template><p>y</template>z</template><p>b</p></article>", "b"),
        ("<article><p>a<svg><style/><title>t</title><foreignObject><div>x</div></foreignObject></svg>b</p><math/>c</article>", "ab c"),
        ("<article><p><a href=/>l<svg></a>b</p></article>", "lb"),
        ("<article><p>a<script>x</script >b<script>y", "ab"),
    ],
)
def test_left_out_elements_end_where_html_ends_them(html, text):
    assert " ".join(_words(parse(html))) == text


def test_layouts_of_one_host_have_main_texts_of_their_own(spark):
    new = "<div class=motto>Our motto</div><article><p>New {0}</p></article>"
    old = "<div class=motto>Our motto</div><div class=content><p>Old {0}</p></div>"
    for url in ("http://mixed.example/", None):
        rows = [(i, url, page((new if i % 3 else old).format(i))) for i in range(12)]
        assert texts(spark, rows) == {i: f"New {i}" if i % 3 else f"Old {i}" for i in range(12)}
    rows = [(i, "http://same.example/", page(new.format(i) if i else "<div class=plain><p>Same</p></div>")) for i in [0, 0, 0, 0, *range(1, 9)]]
    assert texts(spark, rows)[0] == "Same"


def test_repetitions_and_options():
    one, two = (wrappers.induce(parse(h)) for h in ("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>", "<h2>a</h2><p>b</p><hr>"))
    keys = lambda w: [(i.key, i.many, i.maybe) for i in w.parts]
    assert keys(one) == [("(h2. p.)", True, False)]
    both = wrappers._join(one, two)
    for html in ("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>", "<h2>a</h2><p>b</p><hr>"):
        assert wrappers.match(both.parts, parse(html).children) is not None
    assert wrappers.match(both.parts, parse("<table></table>").children) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>x</p>", "<h2>y</h2>", "<ul><li>1<li>2</ul>", "<hr>", "t"]), max_size=8), min_size=1, max_size=5))
def test_a_wrapper_matches_the_pages_it_is_made_of(pages):
    trees = [parse("".join(p)) for p in pages]
    whole = wrappers.induce(trees[0])
    for t in trees[1:]:
        whole = wrappers._join(whole, wrappers.induce(t))
    for slot in _slots(whole):
        slot.main = True
    for t in trees:
        found = wrappers.main_text(whole, t)
        assert found is None or found == " ".join(_words(t))


def _slots(item):
    return [item] if item.key == "#" else [s for p in item.parts or () for s in _slots(p)]


def _words(node):
    return [node.text] if node.key == "#" else [w for c in node.children for w in _words(c)]


def test_extract_query(spark):
    rows = QUERIES["op10_extract"](spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = parse(pages[r.page_id].html.partition("<article>")[2].partition("</article>")[0])
        assert r.text == " ".join(_words(article)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [(str(r.item_id), alnum_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
            rows = docs.collect()
            kept[name] = {r.doc_id: r for r in rows}
            assert len(rows) == len(kept[name])
    clean = {i for i, r in marks.items() if r.quality == 1}
    assert clean <= set(kept["quality"]) and not any(i in kept["quality"] for i, r in marks.items() if r.quality == 0)
    assert sum(i in kept["toxicity"] for i in clean if marks[i].toxic == 0) >= 0.99 * sum(marks[i].toxic == 0 for i in clean)
    assert sum(i in kept["toxicity"] for i in clean if marks[i].toxic == 1) <= 0.4 * sum(marks[i].toxic == 1 for i in clean)
    assert not any(slow_scan(alnum_words(r.text), items, 10)[0] for r in kept["decontamination"].values())
    assert all(r == kept["near_duplicates"][i] or len(r.text) < len(kept["near_duplicates"][i].text) for i, r in kept["decontamination"].items())
    assert {r.doc_id for r in docs.collect()} == set(kept["decontamination"])


@pytest.mark.parametrize("make", [documents, no_documents])
def test_pipeline_edge_cases(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        if name != "packing":
            assert out.columns == docs.columns


def irregular(n, seed):
    rng = random.Random(seed)
    tags = ["p", "ul", "h3", "table", "blockquote", "pre", "dl", "ol", "h4", "section"]
    words = [f"w{seed}x{i}" for i in range(n)]
    return words, "<article>" + "".join(f"<{t}>{w}</{t}>" for w in words for t in [rng.choice(tags)]) + "</article>"


def test_pages_of_many_irregular_siblings(spark):
    """Thousands of terms in a sequence, and a term that has to be given back at its end."""
    pages = [irregular(2500, 1), irregular(300, 2), irregular(40, 3)]
    rows = [(i, f"https://{host}/{i}", html) for i, (_, html) in enumerate(pages) for host in (f"h{i}.example",)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {i: " ".join(words) for i, (words, _) in enumerate(pages)}
    two = [wrappers.induce(parse(html)) for _, html in (irregular(400, 4), irregular(400, 5))]
    both = wrappers._join(*two)
    for _, html in (irregular(400, 4), irregular(400, 5)):
        assert wrappers.match(both.parts, parse(html).children) is not None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.booleans(), st.booleans()), max_size=6), st.text("abc", max_size=7))
def test_matching_is_that_of_a_regular_expression(terms, word):
    """Where a term takes all it can, as Python's possessive quantifiers do."""
    items = [wrappers.Item(k, [], many=many, maybe=maybe) for k, many, maybe in terms]
    node = {c: parse(f"<{t}>text</{t}>").children[0] for c, t in (("a", "h1"), ("b", "h2"), ("c", "h3"))}
    nodes = [node[c] for c in word]
    for item in items:
        item.key = node[item.key].key
    pattern = "".join("(?:" + k + ("++" if many else "") + ")" + ("?" if maybe else "") for k, many, maybe in terms)
    found = wrappers.match(items, nodes)
    assert (found is not None) == bool(re.fullmatch(pattern, word))
    if found is not None:
        assert [n for _, n in found] == nodes
