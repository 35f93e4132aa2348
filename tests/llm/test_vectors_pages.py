"""Vector operators against brute force, and page extraction on markup of many kinds."""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane.llm import ann, html_extract, itq_dedup, queries

KINDS = {"float": np.float32, "double": np.float64}


def vectors(seed, n=900, d=24, groups=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    at = n // 3
    for g in range(groups):
        c = rng.normal(size=d)
        for k in range(g + 2):
            x[at] = c + rng.normal(size=d) * rng.choice([0.05, 0.3, 0.45])
            at += 1
    x[5] = x[4]
    return x.astype(np.float32)


def frame(spark, x, kind="float", extra=()):
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)


BAD = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [float("nan")] * 24, 0), (2004, [None] * 24, 0), (2005, [float("inf")] * 24, 0), (2006, [1.0] * 7, 0), (None, [1.0] * 24, 0)]


@pytest.mark.parametrize("kind,block", [("float", 1024), ("double", 7)])
def test_links_against_brute_force(spark, kind, block, monkeypatch):
    monkeypatch.setattr(itq_dedup, "BLOCK", block)
    x = vectors(1).astype(KINDS[kind])
    y = np.concatenate([x, x[7:8]]).astype(np.float64)
    n = np.linalg.norm(y, axis=1)
    cos = (y @ y.T) / np.outer(n, n)
    want = (cos >= 0.9).sum(axis=1) - 1
    df = frame(spark, x, kind, [(7, [float(v) for v in x[7]], 1), *BAD])
    got = itq_dedup.dedup(df, recall=0.9999).collect()
    assert len(got) == len(x) + 1 + len(BAD)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    found = sum(by[i][0][0] for i in range(len(x)))
    assert found >= 0.995 * want[: len(x)].sum() and all(by[i][0][0] <= want[i] for i in range(len(x)))
    assert len(by[7]) == 2 and by[5][0][1] == by[4][0][1] == 4 and by[4][0][0] >= 1
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert by[i] == [(0, i, True)]
    root = list(range(len(y)))
    for a, b in np.argwhere(cos >= 0.9):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    same = sum(by[i][0][1] == find(i) for i in range(len(x)))
    assert same >= 0.995 * len(x)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq_dedup.dedup(none).count() == 0 and ann.search(none, F.lit(True)).count() == 0
    bad = spark.createDataFrame(BAD[:6], "vec_id long, embedding array<float>, label int")
    assert itq_dedup.dedup(bad).where("kept").count() == 6 and ann.search(bad, F.lit(True)).count() == 0


@pytest.mark.parametrize("n,block", [(900, 8192), (900, 50), (4, 8192), (1, 8192)])
def test_neighbours_against_brute_force(spark, n, block, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", block)
    x = vectors(2)[:n]
    y = x.astype(np.float64)
    norm = np.linalg.norm(y, axis=1)
    df = frame(spark, x, "float", [*BAD, (0, [float(v) for v in x[0]], 3)])
    got = ann.search(df, F.col("vec_id") % 10 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = list(range(0, n, 10))
    hit = total = 0
    for q in asked:
        cos = (y @ y[q]) / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(n), -cos)).tolist() if i != q][:5]
        own = sorted(by.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(order) + 1))
        assert all(abs(cos[v] - s) < 1e-12 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hit += len(set(order) & {v for _, v, _ in own})
        total += len(order)
    assert set(by) <= set(asked) and (not total or hit / total >= 0.9)


def test_probe_order_starts_at_home():
    p = np.array([[[0.1, 0.5], [0.9, 0.2]]])
    steps = ann._steps(2)
    first = steps[ann.probe_order(p, steps, 2)[0, :, 0]]
    second = steps[ann.probe_order(p, steps, 2)[0, :, 1]]
    assert first.tolist() == [[0, 0], [0, 0]] and second.tolist() == [[-1, 0], [1, 0]]


def test_codes_are_balanced():
    planes = itq_dedup.learn(np.random.default_rng(0).normal(size=(3000, 16)), 40)
    bits = np.random.default_rng(1).normal(size=(3000, 16)) @ planes >= 0
    assert planes.shape == (16, 40) and abs(bits.mean(axis=0) - 0.5).max() < 0.1


# pages


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<body><div id=menu><a href=x>Home</a> <a>B</a></div><div class='content'><h1>Ti&eacute;</h1><p>One<br>two <i>x</i>y<p>Three<ul><li>a<li>b</ul><div class='comments'><p>hi</p></div></div><div class=footer>f</div>", "Tié\nOne two xy\nThree\na\nb"),
        ("<html><body class='has-sidebar'><form id=f><main><article class=post><header><h1>T</h1></header><p>text one</p><aside>side</aside><section id='comments'><article class=comment>c</article></section></article></main></form></body>", "T\ntext one"),
        ("<article><p>a&nbsp;&#x4e;\n\t b</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>c</p></article>", "a N b\nc"),
        ("<nav><p>n</p></nav><header><p>h</p></header><div class='cookie-notice'>ok?</div><div role=search>s</div><p>body</p><footer>f</footer>", "body"),
        ("<article><p>x</p><form><input><label>mail</label></form><div class='ad'>buy</div><div id='share-bar'>s</div><p>y</p></article>", "x\ny"),
        ("<article><p>unclosed <b>bold<p>next</article><footer>f", "unclosed bold\nnext"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article><h1>T</h1><p>1 < 2 & 3 > 2</p></article>", "T\n1 < 2 & 3 > 2"),
        ("<ARTICLE><P CLASS=X>Up</P></ARTICLE>", "Up"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
        ("<article><div class='section-header'><h2>Part</h2></div><p class='byline'>By A</p><p>x</p></article><div class='page-header'>no</div>", "Part\nBy A\nx"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_extraction(html, want):
    assert html_extract.extract(html) == want


def test_parser_is_linear():
    for t in ("<" * 200_000, "<a href='" * 30_000, "<p>" * 50_000, "<!--" * 50_000, "&" * 200_000, "<script>" * 20_000, "</div>" * 50_000, "<b x=\"" * 30_000, "<div>" * 30_000 + "</x>" * 30_000, "<x><div>" * 15_000 + "</x>" * 15_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<div class=header>" * 20_000, "<article>" * 20_000):
        html_extract.extract(t)


def page(k, extra="", body=None):
    body = body or f"<p>own text {k} of this page</p><p>more {k * 7}</p>"
    return f"<html><head><title>t{k}</title></head><body><div><span>Site name</span></div><div><p>Read our weekly letter</p></div><div><h1>Title {k}</h1>{body}</div>{extra}<div><p>All rights kept</p></div></body></html>"


def test_wrapper_removes_what_is_constant():
    items = frozenset(html_extract.induce([page(k) for k in range(8)]))
    assert html_extract.extract(page(20), items) == "Title 20\nown text 20 of this page\nmore 140"
    # An inserted block doesn't shift the alignment.
    mixed = [page(k, "<div><p>news %d</p></div>" % k if k % 2 else "") for k in range(8)]
    items = frozenset(html_extract.induce(mixed))
    assert "All rights kept" not in html_extract.extract(page(21, "<div><p>news</p></div>"), items)


def test_copies_and_few_pages_make_no_template():
    same = page(1)
    assert html_extract.induce([same] * 10) == [] and html_extract.induce([page(1), page(2)]) == []


def test_simple_tree_matching():
    a, b = html_extract.parse("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), html_extract.parse("<div><p>1</p><h2>n</h2><p>2</p></div>")
    assert [(x.label, y.label) for x, y in html_extract.align(a, b)].count(("p", "p")) == 2


def test_pages_table(spark):
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(100, None, page(100)), (101, "http://solo.example/", None), (None, "not a url", ""), (3, "http://h.example/3", page(3))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string").repartition(3)
    got = html_extract.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "Title 3\nown text 3 of this page\nmore 21" and by[3]["n_chars"] == len(by[3]["text"])
    assert "Read our weekly letter" in by[100]["text"] and by[101]["text"] == "" and by[None]["text"] == ""
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_registered_queries_are_whole(spark, sf):
    for name, n in (("op10_html", "pages"), ("op7_itq_dedup", "embeddings")):
        assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{n}.parquet").count()


def test_vector_queries_on_the_tables(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    n = np.linalg.norm(x, axis=1)
    cos = (x @ x.T) / np.outer(n, n)
    links = {r["vec_id"]: r["n_links"] for r in queries.op7_itq_dedup(spark, sf).collect()}
    want = (cos >= 0.9).sum(axis=1) - 1
    assert all(links[i] <= w for i, w in zip(ids.tolist(), want.tolist(), strict=True)) and sum(links.values()) >= 0.99 * want.sum()
    got = queries.op6_ann(spark, sf).collect()
    np.fill_diagonal(cos, -2)
    best = {int(ids[k]): set(ids[np.lexsort((ids, -cos[k]))[:5]].tolist()) for k in np.flatnonzero(ids % 50 == 0)}
    assert len(got) == 5 * len(best)
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) >= 0.9 * len(got)


def test_template_of_a_host_full_of_copies(spark):
    """Copies of one page under many ids leave the host's other pages their template, and all of them count."""
    rows = [(k, f"http://h.example/{k}", page(0)) for k in range(200)] + [(1000 + k, f"http://h.example/p{k}", page(k)) for k in range(1, 9)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[1000 + k] == f"Title {k}\nown text {k} of this page\nmore {k * 7}" for k in range(1, 9))
    assert got[5] == "Title 0\nown text 0 of this page\nmore 0"


def test_long_boilerplate_does_not_make_pages_copies():
    legal = "<div><p>" + "No part of this site may be copied without a letter. " * 20 + "</p></div>"
    items = frozenset(html_extract.induce([page(k, legal) for k in range(8)]))
    assert html_extract.extract(page(20, legal), items) == "Title 20\nown text 20 of this page\nmore 140"


def other(k):
    return f"<html><body><section class=top><p>Our other masthead</p></section><section><h2>Other {k}</h2><p>other text {k}</p></section><section class=end><p>Legal words of the other layout</p></section></body></html>"


def test_each_layout_has_its_template(spark):
    rows = [(k, f"http://h.example/{k}", page(k) if k < 8 else other(k)) for k in range(16)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nown text 3 of this page\nmore 21" and got[12] == "Other 12\nother text 12"
    items = frozenset(html_extract.induce([r[2] for r in rows]))
    assert html_extract.extract(other(30), items) == "Other 30\nother text 30"


def test_long_pages_have_a_template():
    body = lambda k: "".join(f"<p>paragraph {i} of {k}</p>" for i in range(1600))
    items = frozenset(html_extract.induce([page(k, body=body(k)) for k in range(5)]))
    assert html_extract.extract(page(9, body=body(9)), items).startswith("Title 9\nparagraph 0 of 9\n") and "All rights kept" not in html_extract.extract(page(9, body=body(9)), items)


@pytest.mark.parametrize("wide", [1, 3])
def test_rows_of_one_id_are_one_candidate(spark, wide):
    """wide spreads the rows of id 7 a little: the best of them counts, and they take one place."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[0] + 0.01 * rng.normal(size=8)
    more = [(7, [float(v) for v in x[7] + 0.001 * (wide - 1) * rng.normal(size=8)], 0) for _ in range(40)]
    y = np.concatenate([x, np.array([m[1] for m in more], dtype=np.float32)]).astype(np.float64)
    ids = np.array([*range(60), *[7] * 40])
    cos = (y @ y[0]) / (np.linalg.norm(y, axis=1) * np.linalg.norm(y[0]))
    best = {i: cos[ids == i].max() for i in range(1, 60)}
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    units = [(0, 0, 0, int(i), False, np.array(v, dtype="<f4").tobytes()) for i, v in zip(ids, y, strict=True)] + [(0, 0, 0, 0, True, x[0].tobytes())]
    df = spark.createDataFrame(units, "tab int, key long, block long, id long, asks boolean, vec binary").coalesce(1)
    got = sorted(ann._ranked(df, "<f4", 5).collect(), key=lambda r: (-r["score"], r["vec_id"]))
    assert [r["vec_id"] for r in got] == want and all(abs(r["score"] - best[r["vec_id"]]) < 1e-12 for r in got)
    found = ann.search(frame(spark, x, extra=more), F.col("vec_id") == 0).orderBy("rank").collect()
    assert found[0]["vec_id"] == 7 and len({r["vec_id"] for r in found}) == 5


def article_of(html: str) -> str:
    """The article of a page of the tables by cutting at its tags: brute force for op10."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", html, re.S)[1]
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|section|pre|blockquote)\b[^>]*>", re.sub(r"<!--.*?-->", "", inner, flags=re.S))
    texts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", x)))).strip() for x in parts]
    return "\n".join(t for t in texts if t)


def test_texts_of_the_pages_table(spark, sf):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op10_html(spark, sf).collect()
    assert len(got) == len(html)
    assert all(r["text"] == article_of(html[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_the_wrapper_alone_finds_the_articles(spark, sf):
    """All structural elements renamed to div and all classes gone, the pages dealt out to five hosts: places and slots decide."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(nav|article|footer|aside|header|main)\b[^>]*>", "<$1div>"), r' class="[^"]*"', "")
    url = F.concat(F.lit("http://h"), (F.col("page_id") % 5).cast("string"), F.lit(".example/"), "page_id")
    got = html_extract.main_text(pages.withColumn("html", bare).withColumn("url", url)).collect()
    assert len(got) == len(html) and all(r["wrapped"] and r["text"] == article_of(html[r["page_id"]]) for r in got)


def test_varying_slots_outside_the_content_go(spark):
    """Neutral names, text that varies everywhere, an inserted element and two sibling articles."""
    def bare(k):
        advert = f"<div><p>Buy thing {k * 13} today</p></div>" if k % 3 == 0 else ""
        return f"<body><div><a href=/>Home</a> <a href=/{k}>page {k}</a></div>{advert}<div><h1>Title {k}</h1><div>{'long own text %d ' % k * 30}</div><div>more {k}</div></div><div>Seen {k * 7} times</div></body>"

    two = lambda k: f"<body><div>Seen {k}</div><main><article><p>{'first %d ' % k * 20}</p></article><article><p>{'second text %d ' % k * 30}</p></article></main></body>"
    rows = [(k, f"http://h.example/{k}", bare(k)) for k in range(12)] + [(100 + k, f"http://two.example/{k}", two(k)) for k in range(8)]
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k]["wrapped"] and got[k]["text"] == f"Title {k}\n{('long own text %d ' % k * 30).strip()}\nmore {k}"
    for k in range(8):
        assert got[100 + k]["text"] == ("first %d " % k * 20).strip() + "\n" + ("second text %d " % k * 30).strip()


@pytest.mark.parametrize("name", ["social-history", "comment-analysis", "alert-systems", "navigation-of-ships"])
def test_ordinary_class_names_keep_their_sections(name):
    assert html_extract.extract(f"<article><p>a</p><section class='{name}'><p>b</p></section></article>") == "a\nb"


@pytest.mark.parametrize("depth", [20, 200, 5000])
def test_depth_changes_nothing(depth):
    deep = "<div>" * depth + "x" + "</div>" * depth
    assert html_extract.extract(f"<div class='content'>{deep}<p>after one</p></div><div><p>tail</p></div>") == "x\nafter one"
    menu = "<div>" * depth + "<nav>menu</nav>x" + "</div>" * depth
    assert html_extract.extract(f"<article>{menu}</article>") == "x"


def test_deep_pages_have_a_wrapper(spark):
    deep = lambda k: f"<body>{'<div>' * 900}<p>{'own text %d ' % k * 20}</p>{'</div>' * 900}<footer><p>Same words</p></footer></body>"
    rows = [(k, f"http://h.example/{k}", deep(k)) for k in range(6)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == ("own text %d " % r["page_id"] * 20).strip() for r in got)


def test_vectors_of_two_widths_meet_their_own(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    y = rng.normal(size=(40, 3)).astype(np.float32)
    y[7] = y[2]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000 + i, [float(v) for v in r], 0) for i, r in enumerate(y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    z = y.astype(np.float64)
    cos = (z @ z.T) / np.outer(np.linalg.norm(z, axis=1), np.linalg.norm(z, axis=1))
    links = {r["vec_id"]: r for r in itq_dedup.dedup(df).collect()}
    want = (cos >= 0.9).sum(axis=1) - 1
    assert [links[1000 + i]["n_links"] for i in range(40)] == want.tolist() and links[1007]["component_id"] <= 1002
    got = ann.search(df, F.col("vec_id").isin(1002, 1005)).collect()
    np.fill_diagonal(cos, -2)
    for q in (1002, 1005):
        order = np.lexsort((np.arange(40), -cos[q - 1000]))[:5] + 1000
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == order.tolist()


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 6))
    x[1] = x[0] * 1.0001
    scale = np.where(np.arange(60) % 3 == 0, 1e300, np.where(np.arange(60) % 3 == 1, 1e-300, 1.0))
    df = spark.createDataFrame([(i, [float(v) for v in r * s], 0) for i, (r, s) in enumerate(zip(x, scale, strict=True))], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in itq_dedup.dedup(df).where("vec_id < 2").collect()} == {0: 1, 1: 1}
    best = ann.search(df, F.col("vec_id") == 0).where("rank = 1").first()
    assert best["vec_id"] == 1 and abs(best["score"] - 1) < 1e-9


def test_extra_columns_with_clashing_names(spark):
    x = vectors(3, n=200)
    df = frame(spark, x)
    more = df
    for c in ("id", "vec", "node", "tab", "key", "width", "rows", "root", "code", "_i", "_b", "_n", "a.b", "links", "component_id"):
        more = more.withColumn(c, F.lit("x"))
    for f in (itq_dedup.dedup, lambda d: ann.search(d, F.col("vec_id") % 10 == 0)):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(more).collect()))
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    odd = pages
    for c in ("host", "frame", "full", "blocks", "sure", "_host", "items", "wrapped", "a.b", "text"):
        odd = odd.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, html_extract.main_text(pages).collect())) == sorted(map(tuple, html_extract.main_text(odd).collect()))


def test_query_row_of_a_repeated_id_is_the_same_each_time(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 50, [float(v) for v in rng.normal(size=6)], 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    one, two = (sorted(map(tuple, ann.search(df.repartition(k), F.col("vec_id") % 10 == 0).collect())) for k in (2, 7))
    assert one == two and len(one) == 25


def test_compared_share_falls_with_the_rows():
    share = []
    for n in (2000, 20000):
        rng = np.random.default_rng(1)
        c = rng.standard_normal((n // 20, 32))
        x = c[rng.integers(0, len(c), n)] + 0.35 * rng.standard_normal((n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pick = rng.permutation(n)[:60]
        s = x[pick] @ x.T
        s[np.arange(60), pick] = -2
        _, got = ann.tune(x[rng.permutation(n)[:800]], x[pick], x[np.argsort(-s, axis=1)[:, :5]], n, n // 50)
        assert got["recall"] >= ann.LEAST
        share.append(got["compared"] / n)
    assert share[1] < 0.5 * share[0] < 0.25 and ann.goal(600, 20) > ann.goal(600, 5000) > 0.92


def test_default_recall_on_links_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    a = x[:1000]
    # Partners at cosines from 0.9 up.
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) / (a * a).sum(axis=1, keepdims=True) * a
    noise *= np.linalg.norm(a, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.902, 0.93, size=(1000, 1))
    x[1000:2000] = cos * a + np.sqrt(1 - cos**2) * noise
    got = itq_dedup.dedup(frame(spark, x, "double")).agg(F.sum("n_links")).first()[0]
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got >= 0.998 * ((y @ y.T >= 0.9).sum() - 3000)


def two_articles(k, wrap="main"):
    body = f"<article><h1>Title {k}</h1><p>First part number {k} with its own words.</p></article>"
    more = f"<article><p>Second part {k * 7} follows, shorter.</p></article>"
    return f"<html><body><nav><a href=x>Home</a></nav><{wrap}>{body}{more}</{wrap}><footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("wrap", ["main", "div", "section"])
@pytest.mark.parametrize("pages", [1, 3, 6])
def test_sibling_articles_are_kept(spark, wrap, pages):
    """On hosts too small for a wrapper too."""
    df = spark.createDataFrame([(k, "http://small.example/a", two_articles(k, wrap)) for k in range(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    assert got == {k: f"Title {k}\nFirst part number {k} with its own words.\nSecond part {k * 7} follows, shorter." for k in range(pages)}


def test_articles_apart_in_main_keep_all_of_it():
    html = "<body><main><p>A lead.</p><section><article><p>One text here.</p></article></section><section><article><p>Two.</p></article><article class=comment><p>me too</p></article></section></main><p>out</p></body>"
    assert html_extract.extract(html) == "A lead.\nOne text here.\nTwo."


def test_repeating_siblings_are_folded():
    folded = html_extract.folded
    assert folded([1, 2, 1, 2, 1, 2]) == ([1, 2], [0, 1, 0, 1, 0, 1])
    assert folded([1, 2, 1, 2, 1]) == ([1, 2, 1], [0, 1, 0, 1, 2])
    assert folded([1, 1, 2, 1, 2, 2]) == ([1, 2], [0, 0, 1, 0, 1, 1])
    assert folded([]) == ([], [])
    out, at = folded([k % 3 for k in range(3000)])
    assert out == [0, 1, 2] and at == [k % 3 for k in range(3000)]
    rnd = random.Random(1)
    for _ in range(200):
        x = [rnd.randrange(3) for _ in range(rnd.randrange(30))]
        out, at = folded(x)
        assert [out[k] for k in at] == x and len(at) == len(x)
        assert not any(out[i : i + p] == out[i + p : i + 2 * p] for p in range(1, 4) for i in range(len(out) - 2 * p + 1))


def test_alignment_of_long_frames_is_quick():
    """Unlike neighbours in turn, and different ones that only the ends have in common."""
    import time

    def page(n, odd):
        parts = "".join(f"<section class=s{k % 2}><div><p>{k}</p></div></section>" for k in range(n))
        return html_extract.ordered_frame(html_extract.parse(f"<body>{parts}{odd}</body>"))[0]

    assert len(page(2000, "").split("\n")) < 10

    def frame(n, at):
        lines = ["-1 #root", "0 body"]
        for k in range(n):
            lines += [f"1 section.s{k}", f"{len(lines)} div.x{k if k != at else 'odd'}"]
        return "\n".join(lines)

    began = time.perf_counter()
    place, _, _ = html_extract.places(frame(3000, -1), frame(3000, 1500))
    assert time.perf_counter() - began < 2 and sum(p >= 0 for p in place) == 2 + 2 * 3000 - 1


def test_alignment_is_the_largest_match():
    """Against simple tree matching without shortcuts."""
    rnd = random.Random(3)

    def tree(depth):
        n = html_extract.Node("div", {"class": rnd.choice("ab")}, None)
        for _ in range(rnd.randrange(4) if depth else 0):
            c = tree(depth - 1)
            c.parent = n
            n.children.append(c)
        return n

    def plain(x, y):
        if x.label != y.label:
            return 0
        p, q = x.children, y.children
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p)):
            for j in range(len(q)):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(p[i], q[j]))
        return 1 + m[-1][-1]

    for _ in range(300):
        a, b = tree(3), tree(3)
        got = html_extract.align(a, b)
        assert len(got) == plain(a, b) and all(x.label == y.label for x, y in got) and len({id(x) for x, _ in got}) == len(got) == len({id(y) for _, y in got})
