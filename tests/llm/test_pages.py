"""Line dedup, main text and archive: the operators over raw pages."""

from __future__ import annotations

import pytest
from brute import archived, main_text
from pyspark.sql import functions as F

from corpusgauge.llm import html_extract as H
from corpusgauge.llm import line_dedup as L
from corpusgauge.llm import warc_store as A
from corpusgauge.llm.frames import table
from corpusgauge.llm.queries import op9_html_extract


def page(body: str) -> str:
    return f"<html><head><title>t</title><script>var x = '<p>';</script></head><body>{body}</body></html>"


# --- line dedup -----------------------------------------------------------------------


def test_site_relative_boilerplate_goes(make_pages):
    rows = [(i, f"https://Site.example:80/{i}", page(f"<nav>Menu &amp; more</nav><p>text {i}</p>\n  <p>twice {i // 5}</p>")) for i in range(10)]
    rows += [(20, "https://other.example/", page("<p>Menu &amp; more</p>")), (21, None, None), (22, "odd", ""), (23, None, "one\ntwo")]
    got = {r.page_id: r for r in L.without_boilerplate(make_pages(rows)).collect()}
    assert got[3].host == "site.example"
    assert got[3].text == "text 3" and (got[3].n_lines, got[3].n_dropped) == (4, 3)  # title, menu, one of five
    assert got[20].text == "t\nMenu &amp; more" and got[20].n_dropped == 0
    assert (got[21].host, got[21].n_lines, got[21].text) == ("", 0, "")
    assert got[23].text == "one\ntwo"


def test_small_and_hot_hosts(make_pages, monkeypatch):
    rows = [(i, "http://two.example/", f"menu\npage {i}") for i in range(2)]
    rows += [(9, "http://one.example/", "menu\nmenu\ntext")]
    rows += [(100 + i, "http://hot.example/", f"top\n{'x' if i < 15 else 'y'}\n{i}") for i in range(50)]
    for salts in (16, 1, 3):
        monkeypatch.setattr(L, "SALTS", salts)
        got = {r.page_id: r.text for r in L.without_boilerplate(make_pages(rows)).collect()}
        assert got[0] == "page 0" and got[1] == "page 1" and got[9] == "menu\nmenu\ntext"
        # 15 of 50 is the ratio itself
        assert got[100] == "x\n0" and got[149] == "49" and len(got) == 53


def test_ratio_counts_pages_not_lines(make_pages):
    rows = [(i, "http://a.example/", "x\nx\nx" if i == 0 else f"y{i}") for i in range(6)]
    got = {r.page_id: r.text for r in L.without_boilerplate(make_pages(rows)).collect()}
    assert got[0] == "x\nx\nx" and got[1] == "y1"
    assert L.without_boilerplate(make_pages([])).collect() == []


# --- main text --------------------------------------------------------------------------

WORDS = "the rain in spain stays mainly in the plain, and so do we. ".split()


def article(i: int) -> str:
    text = " ".join(WORDS[i % 5 :] * (2 + i % 4))
    return f"<article><h1>Head {i}</h1><p>{text}<p><b>{text[:30]}</b>x &amp; y<br>z {i}</p></article>"


def model():
    pages = [
        page(f"<nav><ul><li><a href='/a'>one</a></li><li><a>two</a></li></ul></nav><div class='ad'>buy</div>{article(i)}<footer>&copy; me</footer>")
        for i in range(60)
    ]
    return H.train(pages)


def text_of(source: str | None, trees) -> str:
    read = H.read_page(source or "")
    return H.kept_text(read, H.decode(read, trees.logit(H.features_of(read, trees.odds))))


def test_main_text_without_planted_boilerplate():
    trees = model()
    wanted = text_of(page(article(77)), trees)
    assert wanted.startswith("Head 77 ") and "plain, and" in wanted and wanted.endswith("x & y z 77")
    links = "<ul>" + "<li><a href='/q'>more here</a></li>" * 5 + "</ul>"
    for extra in (
        f"<nav>{links}</nav>",
        "<header><p>The site of all sites</p></header>",
        "<footer>&copy; all of us</footer>",
        f"<aside class='sidebar'>{links}</aside>",
        "<div class='cookie-notice'><p>We use cookies, as you know.</p></div>",
        "<div class='ad'>Buy this now.</div>",
        "<form action='/s'><label>Search</label><input name='q'><button>Go</button></form>",
        "<style>p { margin: 0 }</style><script>track('<p>no</p>')</script>",
        "<section id='comments'><p>I like it, too.</p><p>So do I.</p></section>",
    ):
        assert text_of(page(extra + article(77)), trees) == wanted, extra
        assert text_of(page(article(77) + extra), trees) == wanted, extra


def test_broken_markup_is_read_leniently():
    page_ = H.read_page("<p>a<p>b <i>c</b> d<!-- x")
    assert H.kept_text(page_, [True] * len(page_.parent)) == "a b c d"
    page_ = H.read_page("a &am b &amp c<p class='x")
    assert H.kept_text(page_, [True] * len(page_.parent)) == "a &am b & c"
    page_ = H.read_page("a<script>b")
    assert H.kept_text(page_, [True] * len(page_.parent)) == "a"


def test_unclosed_and_stray_tags_take_linear_time():
    import time

    for source in ("<div>" * 40_000 + "</b>" * 40_000, "<p><select>" + "<b>" * 40_000 + "<div>" * 40_000, "<li><b>" * 40_000):
        start = time.time()
        read = H.read_page(source)
        assert len(read.parent) > 40_000 and time.time() - start < 5
    read = H.read_page("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>x<td>y<tr><td>z</table>")
    assert [t for t in read.tag if t] == ["html", "ul", "li", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td"]
    assert [read.tag[p] for p in read.parent[1:]] == ["html", "ul", "li", "li", "ul", "li", "ul", "li", "html", "table", "tr", "td", "tr", "td", "tr", "tr", "td"]


def test_decoding_never_keeps_a_child_without_its_parents():
    import numpy as np

    page_ = H.read_page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    rng = np.random.default_rng(2)
    for _ in range(50):
        kept = H.decode(page_, rng.normal(size=len(page_.parent)))
        assert all(kept[page_.parent[i]] or not kept[i] for i in range(1, len(kept)))


def test_extraction_of_a_table(make_pages):
    rows = [(i, "u", page(f"<nav><a>x</a></nav>{article(i)}<footer>f</footer>")) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<html><body></body></html>"), (0, "u", rows[0][2])]
    pages = make_pages(rows)
    got = H.extracted(pages, H.fit(pages)).collect()
    assert len(got) == 44
    texts = {r.page_id: r.text for r in got}
    assert texts[7].startswith("Head 7 ") and texts[7].endswith("z 7")
    assert texts[100] == texts[101] == texts[102] == ""
    empty = make_pages([])
    assert H.fit(empty) is None and H.extracted(empty, None).collect() == []


def test_training_takes_declaring_pages_only(make_pages, monkeypatch):
    rows = [(i, "u", page(f"<div><p>plain {i}</p></div>")) for i in range(60)]
    rows += [(100 + i, "u", page(f"<main id='app'></main><!-- <article> --><p>empty {i}</p>")) for i in range(30)]
    rows += [(200 + i, "u", page(article(i))) for i in range(9)]
    taken = []
    monkeypatch.setattr(H, "train", taken.extend)
    H.fit(make_pages(rows), 6)
    assert len(taken) == 6 and all("<h1>Head" in html for html in taken)
    taken.clear()
    H.fit(make_pages(rows[:60] + rows[90:]), 20)
    assert sorted(taken) == sorted(html for _, _, html in rows[90:])


def test_fixture_pages_as_by_brute_force(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    wanted = sorted((r.page_id, main_text(r.html or "")) for r in pages.collect())
    got = op9_html_extract(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.page_id, r.text) for r in got) == wanted
    assert all(r.n_chars == len(r.text) for r in got)


# --- archive ----------------------------------------------------------------------------

BIG = "é" * 600


def key(row) -> tuple:
    return (*row[:4], -1 if row[4] is None else row[4])


def test_archive_as_by_brute_force(spark, make_pages):
    rows = [(1, BIG), (2, BIG), (9, BIG), (3, "small"), (4, "small"), (5, None), (6, ""), (7, "x" * 1000), (8, "x" * 999), (10, "x" * 999)]
    pages = make_pages([(i, f"http://a/\r\nWARC-Type: no{i}", h) for i, h in rows])
    got = [tuple(r) for r in A.archived(spark, pages).collect()]
    assert sorted(map(key, got)) == sorted(map(key, archived(rows)))


def test_records_are_rebuilt_whole_and_payloads_kept_once(spark, make_pages):
    pages = make_pages([(1, "http://a/1", BIG), (2, None, BIG), (3, "http://a/3", "kurz")])
    archive = A.write_archive(pages)
    assert archive.payloads.count() == 2
    records = {r.page_id: bytes(r.record) for r in A.read_records(archive).collect()}
    assert records[2].endswith(b"\r\n\r\n" + BIG.encode() + b"\r\n\r\n")
    assert b"WARC-Type: revisit" in records[1] and BIG.encode() not in records[1]
    assert b"WARC-Target-URI: http://a/3\r\n" in records[3]
    head, _, body = records[3].partition(b"\r\n\r\n")
    assert f"Content-Length: {len(body) - 4}".encode() in head
    assert A.archived(spark, make_pages([])).collect() == []


@pytest.mark.parametrize(
    ("part", "pattern", "to"),
    [
        ("head", r"Content-Length: \d+", "Content-Length: 7"),
        ("head", r"Content-Length: \d+", "Content-Length: 99999"),
        ("head", r"^WARC/1.1\r\n", ""),
        ("http", r"Content-Length: \d+", "Content-Length: 7"),
        ("http", r"\r\n\r\n$", ""),
    ],
)
def test_records_of_another_form_fail(spark, make_pages, part, pattern, to):
    archive = A.write_archive(make_pages([(1, "http://a/1", BIG), (2, None, BIG), (3, "http://a/3", "kurz")]))
    assert A.parsed(A.read_records(archive)).count() == 3
    broken = archive.records.withColumn(part, F.regexp_replace(part, pattern, to))
    for page_id in (1, 2, 3):
        read = A.read_records(A.Archive(broken.filter(F.col("page_id") == page_id), archive.payloads))
        with pytest.raises(Exception, match="stated lengths"):
            A.parsed(read).collect()
