"""Wrappers and the article text of pages; the pipeline's stages."""

import html
import re

import pytest
from pyspark.sql import functions as F

from drivegrid.llm import wrappers
from drivegrid.llm.wrappers import align, article_path, fold, main_text, merge, parse, wrapper_of


def rows(df):
    return [r.asDict() for r in df.collect()]


def names(part):
    return part[0].replace("1", "") + part[1] + ("" if part[1] == "#text" else "(" + " ".join(names(p) for p in part[2]) + ")")


def page(body):
    return wrapper_of(parse(f"<html><body>{body}</body></html>"))


def test_alignment_makes_optional_and_repeated_parts():
    one = page("<h1>A</h1><p>x</p><p>y</p><div>z</div>")
    two = page("<h1>B</h1><p>x</p><ul><li>1<li>2</ul>")
    whole = merge(one, two)
    assert names(whole) == "#root(html(body(h1(#text) +p(#text) ?div(#text) ?ul(+li(#text)))))"
    h1 = whole[2][0][2][0][2][0]
    assert h1[2][0][2][0] is None and merge(one, one)[2][0][2][0][2][0][2][0][2][0] == "A"


def test_groups_of_several_elements_fold():
    assert names(page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")) == "#root(html(body(dl(+#group(dt(#text) dd(#text))))))"
    part = lambda n: ["1", n, []]
    assert [p[0] + p[1] for p in fold([part("a"), part("a"), part("b")])] == ["+a", "1b"]
    assert [p[0] + p[1] for p in align([part("a")], [])] == ["?a"]


def test_parser_repairs_markup():
    t = "<p>one<p>two<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><script>var a='</p><b>'</script>&lt;end&gt; a < b"
    assert main_text(t, None) == "one\n\ntwo\n\nx\n\ny\n\n1\n\n2\n\n3\n\n<end> a < b"
    assert main_text("<title>t</title><p>a&nbsp;b &amp;amp; c<br>d<!-- no --></p><p></p>", None) == "a b &amp; c d"


@pytest.mark.parametrize("source,text", [
    ('<article><div style="overflow:hidden"><p>whole body</p></div></article>', "whole body"),
    ('<article>see <a href="/hidden-gems">these gems</a> now</article>', "see these gems now"),
    ('<article><p data-hidden="false">x y</p><p hidden>z</p><p hidden=until-found>u</p></article>', "x y\n\nu"),
    ("<a href=/x title=O'Brien>Link</a> body it's here", "Link body it's here"), ('<a href="x>Link</a> body <p>more', "Link body\n\nmore"),
    ('<article><p class="share">Share of votes</p><div class="share">Post it</div></article>', "Share of votes"),
    ('<div id="sidebar" width="600" data-id="content"><p>side</p></div><p>one two three</p>', "one two three"),
    ('<p class="x" class="ad">text</p>', "text"),
    ("", ""), ("no markup  here", "no markup here"), ("<article>", ""), ("<p", "<p"), ("<!-- only", ""), ("<nav>menu</nav>", ""),
    ("<div><header><h1>Site</h1></header><article><header><h2>Title</h2></header>Body</article></div>", "Title\n\nBody"),
])
def test_odd_sources(source, text):
    assert main_text(source, None) == text


def test_article_without_an_article_element():
    t = (
        '<header class="site"><a>Home</a></header><div id="wrap"><div class="sidebar"><p>side</p></div><div class="content"><h2>Head</h2>'
        "<p>One <i>two</i>\nthree<p>four five six seven eight nine ten</p><form>q</form><section class='comments'><p>nice</p></section></div></div>"
        '<div class="cookie-notice">We use cookies</div><footer>f</footer>'
    )
    assert article_path(wrapper_of(parse(t)))[-1] == "div.content"
    assert main_text(t, None) == "Head\n\nOne two three\n\nfour five six seven eight nine ten"


def test_all_pages_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in rows(wrappers.extract(df))}
    assert len(got) == df.count()
    for r in rows(df):
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_wrappers_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = {r["host"]: r["path"] for r in rows(wrappers.infer_wrappers(df.coalesce(1)))}
    many = {r["host"]: r["path"] for r in rows(wrappers.infer_wrappers(df.repartition(9), fan_in=2))}
    assert one == many


def test_odd_pages(spark):
    data = [(1, None, None, "x"), (2, "nonsense", "<p>a b</p>", "x"), (None, "http://h.example/", "<p>c</p>", "x"), (3, "http://h.example/2", "<p>" + "word " * 200_000, "x"), (3, "http://h.example/2", "", "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    got = sorted((str(r["page_id"]), r["url"], len(r["text"]), r["n_chars"]) for r in rows(wrappers.extract(df)))
    assert got == [("1", None, 0, 0), ("2", "nonsense", 3, 3), ("3", "http://h.example/2", 0, 0), ("3", "http://h.example/2", 999_999, 999_999), ("None", "http://h.example/", 1, 1)]
    assert wrappers.extract(df.limit(0)).collect() == []


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline as cp
    from drivegrid.llm import exact_copies, jaccard_join
    from drivegrid.llm.common import written

    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "12 34", "en", None, 5), (10_003, "", None, None, 0)], docs.schema)
    state = {"docs": written(docs.unionByName(extra))}
    for name, stage in cp.STAGES:
        before, after = state["docs"], written(stage(spark, state["docs"], sf_dir))
        if name != "pack_sequences":
            assert after.columns == docs.columns
        if name == "language_id":
            assert {r[0] for r in before.join(after, "doc_id", "left_anti").select("doc_id").collect()} == {10_001, 10_002, 10_003}
        if name == "exact_dedup":
            assert after.count() == before.select(exact_copies.normalised("text")).distinct().count()
        if name == "near_dedup":
            assert jaccard_join.near_copies(after).agg(F.sum("n_links")).first()[0] == 0
        if name == "mix_sources":
            assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
            assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
        if name == "pack_sequences":
            assert after.filter("piece = 0 AND start = 0").count() == before.count()
        state["docs"] = after
    assert cp.run(spark, sf_dir).count() > 0


def test_words_within_ids_do_not_drop_article_text():
    parts = [
        '<h2 id="related-work">Related work</h2>', '<section id="navigation">How birds find home</section>', '<div id="social-history">A history of towns</div>',
        '<h3 id="share-of-votes">Share of votes</h3>',
    ]
    want = ["Related work", "How birds find home", "A history of towns", "Share of votes", "The end " * 3]
    for tag in ("article", "div id=content"):
        body = "".join(parts) + "<p>" + want[-1] + "</p><div class='share'>Post it</div>"
        page = f"<html><body><div class='site-nav'>Home News</div><{tag}>{body}</{tag.split()[0]}></body></html>"
        assert wrappers.main_text(page, None) == "\n\n".join(w.strip() for w in want)


def test_a_form_around_the_page_is_a_container():
    page = "<html><body><form id=aspnetForm><p>" + "word " * 30 + "</p><p>End</p><form class=x><p>Your name</p></form></form></body></html>"
    assert wrappers.main_text(page, None).startswith("word word") and "End" in wrappers.main_text(page, None)
    small = "<html><body><article><p>" + "word " * 30 + "</p><form><p>Your name</p></form></article></body></html>"
    assert "name" not in wrappers.main_text(small, None)


def test_class_words_on_text_are_judged_by_the_host(spark):
    """What is the same on all pages of a host is its template; what differs is the article's."""
    body = lambda k: f'<article><p class="share">Share this page</p><p class="notice">Notice {k} of the town</p><p>Text {k} of the page with some words.</p></article>'
    df = spark.createDataFrame([(k, f"http://h.example/{k}", body(k)) for k in range(6)], "page_id long, url string, html string")
    for r in rows(wrappers.extract(df.repartition(3))):
        assert r["text"] == f"Notice {r['page_id']} of the town\n\nText {r['page_id']} of the page with some words."


@pytest.mark.parametrize("source", ["<div>" * 50_000 + "deep", "<b>" * 50_000 + "deep", "<form>" * 20_000 + "deep", "<ul><li>" * 20_000 + "deep"])
def test_any_depth(source):
    one, two = wrapper_of(parse(source)), wrapper_of(parse(source + "er"))
    whole = merge(one, two)
    items = wrappers.flat(whole)
    assert wrappers.flat(wrappers.unflat(items)) == items and wrappers.constant_labels(whole) == []
    assert main_text(source, article_path(whole)) == main_text(source, None) == "deep"


@pytest.mark.parametrize("source", ['<a "' * 250_000, '<a x="1" ' * 100_000 + 'y=">"', "<a x='" * 150_000, "<" * 500_000, "<!-" * 300_000, "<a =" * 200_000 + ">"])
def test_broken_tags_take_linear_time(source):
    import time

    start = time.time()
    main_text(source, None)
    assert time.time() - start < 5


def brute_align(a, b):
    """Length of a longest common sequence, cell by cell."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def matches(part, labels):
    """Does a flat expression (no groups) match a sequence of labels? A set of states."""
    at = {0}
    for count, name, _ in part:
        step = lambda s: {k + 1 for k in s if k < len(labels) and labels[k] == name}
        one = step(at)
        if count in "+*":
            more = one
            while more:
                more = step(more) - one
                one |= more
        at = one | (at if count in "?*" else set())
    return len(labels) in at


def test_wrappers_match_the_pages_they_came_from():
    """Random sequences: the common sequence is longest, and the expression matches both."""
    import random

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice(["p", "h2", "ul", "hr", "em"]) for _ in range(rng.randrange(9))] for _ in range(2))
        part = lambda names_: [["1", n, []] for n in names_]
        pairs = wrappers._common(part(a), part(b))
        assert len(pairs) == brute_align(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        whole = align(part(a), part(b))
        if all(p[1] != "#group" for p in whole):
            assert matches(whole, a) and matches(whole, b)


def plain_path(sources):
    """The article's path by plain means: of all label paths whose texts differ between the pages
    the deepest block, or article, that holds most of these words."""
    pages = [parse(s) for s in sources]
    seen = {}

    def walk(e, path, page, out):
        for c in e.children:
            if isinstance(c, str):
                for word in c.split():
                    out.setdefault(path, []).append(word)
            elif not (c.aside or c.weak or c.named):
                walk(c, (*path, c.label), page, out)

    for k, page in enumerate(pages):
        out = {}
        walk(page, ("#root",), k, out)
        for path, words in out.items():
            seen.setdefault(path, []).append(tuple(words))
    varying = {p: sum(map(len, w)) for p, w in seen.items() if len(set(w)) > 1}
    total = sum(varying.values())
    holds = {}
    for p, n in varying.items():
        for k in range(1, len(p) + 1):
            holds[p[:k]] = holds.get(p[:k], 0) + n
    marked = [p for p in holds if p[-1].split(".")[0] == "article" and holds[p] >= 0.3 * total]
    return list(max(marked, key=holds.get)) if marked else None


def test_paths_agree_with_plain_inference(spark):
    from collections import defaultdict

    hosts = defaultdict(list)
    for r in rows(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")):
        hosts[re.match(r"\w+://([^/?#:]*)", r["url"])[1].lower()].append(r["html"])
    import json

    got = {r["host"]: json.loads(r["path"]) for r in rows(wrappers.infer_wrappers(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))}
    several = {h: s for h, s in hosts.items() if len(s) > 1}
    assert several and all(got[h] == plain_path(s) for h, s in several.items())
