"""Pages, embeddings, and the registered queries against their SQL or brute force."""

import base64
import hashlib
import html
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from corpusmill.llm import archive, html_text, topk
from corpusmill.llm import queries as llm
from corpusmill.session import staging_path
from tools.check import compare, database

PAGES = "page_id long, url string, html string"


# --- html ----------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<nav><ul><li><a href="/x">menu</a></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<header>site</header><article><h1>Head &amp; line</h1><p><b>first</b>  one<br>two<p>second &copy;
<script>if (a < b) x("</p>")</script><ul><li>item<li>next</ul><!-- c --><table><tr><td>cell<td>other</table>
<div class="share-buttons">share</div><section id="comments"><p>reader</p></section></article>
<aside>more</aside><form><input>send</form><footer>&copy; f</footer></body></html>"""


def test_extraction_keeps_the_article_only():
    want = ["Head & line", "first one two", "second ©", "item", "next", "cell", "other"]
    assert html_text.extract(PAGE) == "\n\n".join(want)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &lt;text", "plain <text"),
        ("<p>a<p>b</div>c", "a\n\nbc"),
        ("<div><p>a <i>b</div> c", "a b\n\nc"),
        ("<article><p>unclosed <b>x", "unclosed x"),
        ("<script>never closed", ""),
        ("<p>a < b and b > a</p>", "a < b and b > a"),
        ("<p title='x > y'>quoted</p>", "quoted"),
        ("<main>one</main><p>two</p>", "one"),
        ("<p hidden>no</p><p>yes&nbsp;&#x41;</p>", "yes A"),
        ("<" * 2000 + "p>" + "<div>" * 3000 + "deep", None),
    ],
)
def test_extraction_of_odd_pages(page, text):
    got = html_text.extract(page)
    assert got == text if text is not None else "deep" in got


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="site-content no-sidebar"><article><p>Real text.</p></article></div>', "Real text."),
        ('<div id="page" class="has-sidebar"><p>Real text.</p></div>', "Real text."),
        ('<body class="home sidebar"><p>Real text.</p></body>', "Real text."),
        ('<div class="sidebar-layout"><main><p>Real text.</p></main></div>', "Real text."),
        ('<div class="sidebar"><main><p>Real text.</p></main></div>', "Real text."),
        ('<article><p>a</p><section class="related-work"><p>b</p></section></article>', "a\n\nb"),
        ('<article><p>a</p><div class="related"><p>b</p></div><p>c</p></article>', "a\n\nc"),
        ('<article><p>a</p><div class="related-posts sponsor-note"><p>b</p></div></article>', "a\n\nb"),
        ('<p>He signs the <span class="notice">notice</span> here</p>', "He signs the notice here"),
        ('<p>Press <b id="menu">Menu</b> <span hidden>now</span></p>', "Press Menu"),
        ("<article><p>teaser</p></article><main><p>the long story of it all</p></main>", "the long story of it all"),
        ("<main><article><p>the long story</p></article><p>by me</p></main>", "the long story"),
        ('<article><p>a story</p></article><div class="sidebar"><article><p>teaser</p></article></div>', "a story"),
        ('<div class="comments"><article><p>reader</p></article></div><p>y</p>', "y"),
        ('<div class="siteFooter">f</div><div class="ad-728">k</div><div class="adBox">s</div><p>z</p>', "z"),
        ('<div class="ads left"><p>x</p></div><div class="loads"><p>y</p></div>', "y"),
        ('<div class="share_buttons">s</div><div class="shareholders"><p>z</p></div>', "z"),
        ('<div class="article-header"><h1>Head</h1></div><div class="page-header">p</div><p>z</p>', "Head\n\nz"),
        ('<div class="comment-list"><p>c</p></div><div class="commentary"><p>z</p></div>', "z"),
        ('<div class="newsletter signup">n</div><div class="newsletter-archive"><p>z</p></div>', "z"),
    ],
)
def test_classes_name_boilerplate_as_wholes(page, text):
    assert html_text.extract(page) == text


def test_lists_and_tables_of_an_article_are_no_templates(spark):
    rows = []
    for i in range(30):
        body = f"<p>own {i}</p><ul><li>Preheat the oven</li></ul><table><tr><td>cup</td></tr></table><aside>x</aside>"
        rows.append((i, f"http://a.example/{i}", f"<article>{body}</article><ul><li>start</li></ul>"))
    texts = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts[3] == "own 3\n\nPreheat the oven\n\ncup"


@pytest.mark.parametrize("most", [0, 1000])
def test_templates_of_a_host_are_deleted(spark, most):
    rows = []
    for i in range(12):
        body = f"<div><p>offer of the week</p></div><p>own text {i}</p><p>always said</p>"
        rows.append((i, f"http://a.example/{i}", f"<body>{body}</body>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<article>{body}</article>"))
    rows += [(200, "http://c.example/", rows[0][2]), (201, None, None), (None, "x", ""), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, PAGES)
    got = [tuple(r) for r in html_text.main_texts(frame, most).collect()]
    assert len(got) == len(rows)
    texts = {i: t for i, _, t in got}
    assert texts[3] == "own text 3"
    assert texts[103] == "own text 3\n\nalways said"  # an article's paragraphs stay
    assert texts[200] == "offer of the week\n\nown text 0\n\nalways said"
    assert texts[201] == "" and texts[None] == ""
    assert html_text.main_texts(frame.limit(0)).count() == 0


def test_templates_of_a_section_of_a_large_host_are_deleted(spark):
    rows = []
    for i in range(300):  # ten sections; each has its own notice, on a tenth of the host's pages
        notice = f"<div><p>news of section {i % 10}</p></div>"
        body = f"{notice}<article><p>own text {i}</p><p>said in section {i % 10}</p></article>"
        rows.append((i, f"http://a.example/{i}", f"<body>{body}</body>"))
        rows.append((1000 + i, f"http://b.example/{i}", f"<body>{notice}<p>own text {i}</p></body>"))
    texts = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts[1003] == "own text 3"
    assert texts[3] == "own text 3\n\nsaid in section 3"  # an article's paragraphs stay


def test_html_query_against_another_reading(spark, sf_dir):
    rows = duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall()
    want = {}
    for page_id, page in rows:
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)[^>]*>", "\0", inner))).split("\0")
        texts = (" ".join(html.unescape(p).split()) for p in parts)
        want[page_id] = "\n\n".join(t for t in texts if t)
    got = llm.QUERIES["op4_html"](spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


# --- archive -------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    body = "<p>é</p>"
    rows = [
        (1, "http://www.b.example/x", body),
        (5, "http://www.b.example/x", body),
        (5, "http://www.b.example/x", body),
        (3, "https://user@a.example:80/y?q#f", "other"),
        (7, None, None),
        (8, "no host\r\nInjected: 1", ""),
        (None, "http://c.example", body),
        (9, "http://c.example/ü", "z" * 100_000),
    ]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = sorted(map(tuple, archive.archived(pages).collect()), key=str)
    best = {}
    for i, _, p in rows:
        best[p or ""] = max(best.get(p or "", -1), -1 if i is None else i)
    want = []
    for i, _, p in rows:
        raw = (p or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = best[p or ""] == i
        want.append((i, len(raw), digest, "response" if first else "revisit", None if first else best[p or ""]))
    assert got == sorted(want, key=str)
    assert archive.archived(pages.limit(0)).count() == 0


def test_lookup_finds_keys_that_fill_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(archive, "CAPTURES", 4)
    monkeypatch.setattr(archive, "PLACES", 2)
    hot = [(i, "http://hot.example/same", f"{i % 5}") for i in range(60)]
    rows = hot + [(100 + i, f"http://{'abhxz'[i % 5]}.example/{i // 10}", "x") for i in range(60)]
    folder = staging_path(spark, "hot-key")
    captures = archive.write_archive(spark.createDataFrame(rows, PAGES), folder)
    blocks = archive.write_index(captures, folder)
    whole = sorted(map(tuple, archive.read_archive(blocks, folder, folder).collect()))
    assert [r[0] for r in whole] == [r[0] for r in rows]
    assert sorted(map(tuple, archive.lookup(captures, blocks, folder, folder).drop("key").collect())) == whole
    asked = [("http://hot.example/same",), ("http://hot.example/sam",), ("http://a.example/0",), (None,)]
    got = archive.lookup(spark.createDataFrame(asked, "url string"), blocks, folder, folder).collect()
    wanted = {i for i, u, _ in rows if (u,) in asked}
    assert {r["page_id"] for r in got} == wanted and len(got) == len(wanted)


def test_captures_are_found_by_url(spark):
    rows = [(i, f"http://h{i % 7}.example/{i // 3}", f"page {i}") for i in range(3000)]
    folder = staging_path(spark, "lookup")
    blocks = archive.write_index(archive.write_archive(spark.createDataFrame(rows, PAGES), folder), folder)
    asked = ["http://h3.example/1", "http://H3.example/500", "http://h9.example/1", "http://h0.example/0"]
    urls = spark.createDataFrame([(u,) for u in asked], "url string")
    got = {r["page_id"] for r in archive.lookup(urls, blocks, folder, folder).collect()}
    assert got == {i for i, u, _ in rows if u in {a.lower() for a in asked}}


# --- top k ---------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = np.random.default_rng(1)
    vectors = [(i, draw.normal(0, 0.3, 8).astype("f4").tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(30)]  # ties
    odd = [(50_000, None), (50_050, [1.0, None]), (50_100, [float("nan")]), (None, [1.0] * 8), (2001, []), (2002, [0.5])]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").repartition(4)
    got = [tuple(r) for r in topk.top_k(frame).collect()]
    usable = vectors + [(2001, []), (2002, [0.5])]
    held = np.zeros((len(usable), 8), np.int64)
    for k, (_, v) in enumerate(usable):
        held[k, : len(v)] = np.floor(256 * np.array(v, "f4").astype("f8"))
    ids = np.array([i for i, _ in usable])
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = held @ held[q]
        order = [k for k in np.lexsort((ids, -scores)) if k != q][:5]
        want += [(int(ids[q]), r + 1, int(ids[k]), int(scores[k])) for r, k in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id in (0, 2002)")).count() == 1


def test_index_stops_on_proof():
    matrix = np.zeros((500, 16), np.int64)
    matrix[:, 0] = np.arange(500) * 10
    matrix[:, 1:] = np.random.default_rng(0).integers(-2, 3, (500, 15))
    queries = np.zeros((1, 16), np.int64)
    queries[0, 0] = 7
    (scores, ids), = topk.Index(np.arange(500), matrix).best(queries, np.array([499]))
    assert list(ids) == [498, 497, 496, 495, 494] and list(scores) == [7 * 10 * i for i in ids]


def test_a_zero_component_has_no_posting():
    matrix = np.array([[0, 5, 0], [3, 0, 0], [0, 0, 0], [-7, 2, 0]])
    index = topk.Index(np.arange(4), matrix)
    held = [(c, v) for postings, _, _ in index.segments for c, vectors, _ in postings for v in vectors]
    assert sorted(held) == [(0, 1), (0, 3), (1, 0), (1, 3)]
    most = [m for _, m, _ in index.segments]
    assert most == sorted(most, reverse=True) and most[-1] == 0


@pytest.mark.parametrize("floor", [-np.inf, 4, 5, 6])
def test_a_floor_keeps_what_reaches_it(floor):
    matrix = np.array([[5], [4], [5], [1], [-3]])
    (scores, ids), = topk.Index(np.arange(5), matrix).best(np.array([[1]]), np.array([9]), 3, np.array([floor]))
    want = [(s, i) for s, i in [(5, 0), (5, 2), (4, 1)] if s >= floor]
    assert list(zip(scores.tolist(), ids.tolist()))[: len(want)] == want


def test_a_shard_of_several_blocks_and_cells(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "TILE", 4)
    draw = np.random.default_rng(3)
    batches, want = [], []
    for cell in (0, 2, 5):
        held = draw.integers(-4, 5, (300, 6))
        held[draw.integers(0, 300, 40)] = held[0]  # ties in every block
        ids = draw.permutation(300)
        asked = [0, 7, 11, 13, 290]
        rows = [(cell, 0, int(i), v.tolist()) for i, v in zip(ids, held)]
        rows += [(cell, 1, q, (held[ids == q][0].tolist() + [9, 9])[: 8 if q % 2 else 4]) for q in asked]
        for kind, _, q, v in [(r[1], r[0], r[2], r[3]) for r in rows]:
            if kind:
                query = np.array((v + [0] * 6)[:6])
                scores = held @ query
                order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:5]
                want += [(q, int(ids[k]), int(scores[k])) for k in order]
        columns = [pa.array([r[j] for r in rows]) for j in range(3)]
        columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int64())))
        batch = pa.RecordBatch.from_arrays(columns, ["cell", "kind", "id", "impacts"])
        batches += [batch.slice(0, 150), batch.slice(150)]
    lone = pa.RecordBatch.from_arrays(
        [pa.array([7]), pa.array([1]), pa.array([3]), pa.array([[1]], pa.list_(pa.int64()))], batch.schema.names
    )  # a query without candidates
    got = [row for out in topk._search(5)(iter([*batches, lone])) for row in zip(*[c.to_pylist() for c in out])]
    assert sorted(got) == sorted(want)


# --- registered queries --------------------------------------------------------------------------


def test_every_operator_is_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(llm.ORACLES) <= set(llm.QUERIES)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    assert compare(spark, database(sf_dir), name, sf_dir) is None
