import base64
import hashlib

import pytest

from labelway.llm import html as H
from labelway.llm import warc as W
from labelway.llm.common import table
from labelway.session import scratch_path, stage_table

NASTY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", "<p>same</p>" if i % 3 else f"<p>{NASTY}{i}</p>" * 50) for i in range(12)]
    rows += [(20, None, None), (21, "http://x\r\ny", ""), (None, "u", "<p>same</p>"), (11, "again", "<p>same</p>")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_bytes string")


def expected(rows, least=0):
    groups = {}
    for page_id, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        same = groups[html or ""]
        top = max((x for x in same if x is not None), default=None)
        revisit = len(data) >= least and top is not None and page_id != top
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((str(page_id), len(data), digest, "revisit" if revisit else "response", str(top) if revisit else "None"))
    return sorted(out)


@pytest.mark.parametrize("least,chunk", [(0, 100), (12, 1 << 20)])
def test_archives_round_trip(spark, pages, least, chunk):
    cfg = W.WarcConfig(min_revisit_bytes=least, chunk_bytes=chunk)
    folder = scratch_path(spark, "warc")
    paths = stage_table(W.write_archives(pages, folder, cfg), "paths")
    rows = W.read_archives(paths, folder, cfg).collect()
    assert max(len(r.data) for r in rows) <= chunk
    got = sorted(
        (r.record_id[12:-1].replace("null", "None"), r.bytes_so_far, r.digest_so_far, r.record_type, str(r.refers_to and r.refers_to[12:-1]))
        for r in rows if r["last"]
    )
    source = [(r.page_id, r.html) for r in pages.collect()]
    assert got == expected(source, least)
    payloads = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        if r.record_type == "response" and r.record_id not in ("<urn:x-page:11>", "<urn:x-page:null>"):
            payloads[r.record_id] = payloads.get(r.record_id, b"") + bytes(r.data)
    assert all(payloads.get(W.record_id(i), (h or "").encode()) == (h or "").encode() for i, h in source)


def test_warc_query(spark, sf):
    got = sorted(
        (str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to))
        for r in W.q_warc(spark, sf).collect()
    )
    assert got == expected([(r.page_id, r.html) for r in table(spark, sf, "pages").collect()])


CASES = [
    (None, ""), ("", ""), ("plain  text < 5 &amp; 3", "plain text < 5 & 3"),
    ("<nav><ul><li>x<article><h1>T</h1><p><b>a<br>b<p>c</p><div class='ad'>z</div><p>d</article> foo", "T\n\na b\n\nc\n\nd"),
    ("<body><div class=header>m</div><p title='a>b'>one &eacute;&#65;&copy<script>'</p>'</script><p>two", "one éA©\n\ntwo"),
    ("<article><header><h1>T</h1></header><p>x<section id=comments><p>bad</section></article>", "T\n\nx"),
    ("<main><p>a<!-- <p>no</p> -->b<style>p{}</style></p><form>f</form><aside>s</aside></main><footer>c", "ab"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("hidden", ["<!-- <main > -->", "<script>'<article>'</script>", "<noscript><main></noscript>"])
def test_article_in_markup_that_is_not_read(hidden):
    assert H.main_text(f"<body>{hidden}<p>text</p></body>") == "text"


def test_templates_of_a_host(spark):
    def page(i):
        return f"<body><div><p>Site name</p><ul><li>Home<li>About</ul></div><div><p>Story {i} text</p></div></body>"

    rows = [(i, "http://a.org/x", page(i)) for i in range(6)] + [(9, "http://b.org/x", page(9)), (10, None, None)]
    # copies of one page are one page, and make no template of its story
    rows += [(20 + i, "http://c.org/x", page(7)) for i in range(5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(docs).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Story 3 text" and got[10] == ""
    assert got[9] == "Site name\n\nHome\n\nAbout\n\nStory 9 text" and got[22].endswith("Story 7 text")
    assert H.extract(docs.limit(0)).count() == 0


def test_templates_inside_articles_and_on_large_hosts(spark):
    def marked(i):
        advert = "<div class=box><p>Buy two</p></div>" if i % 4 == 0 else ""
        quoted = "<p>As they say</p>" if i < 8 else ""
        return f"<body><div>Site</div><main><h1>Title {i}</h1>{advert}{quoted}<p>Story {i}</p></main></body>"

    def plain(i):
        return f"<body>{'<div>Buy two</div>' if i % 4 == 0 else ''}<div><p>Story {i}</p></div></body>"

    rows = [(i, "http://a.org/x", marked(i)) for i in range(100)]
    rows += [(1000 + i, "http://b.org/x", plain(i)) for i in range(500)]
    # one article under many different frames recurs as an article, not as a template
    rows += [(5000 + i, "http://c.org/x", f"<p>{i}</p>" + marked(0)) for i in range(30)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(docs).collect()}
    assert got[4] == "Title 4\n\nAs they say\n\nStory 4" and got[40] == "Title 40\n\nStory 40"
    assert got[1004] == "Story 4" and got[1005] == "Story 5"
    assert got[5003] == "Title 0\n\nBuy two\n\nAs they say\n\nStory 0"


def test_html_query_keeps_whole_articles(spark, sf):
    rows = H.q_html_text(spark, sf).collect()
    assert len(rows) == table(spark, sf, "pages").count() and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_deep_nesting_takes_linear_time():
    import time

    page = "<article>" + "<div>" * 20_000 + "text" + "<b>" * 20_000 + "<p>" * 50 + "more"
    start = time.process_time()
    assert H.main_text(page) == "text\n\nmore"
    assert len(H.subtrees(page)[0]) >= 3
    assert time.process_time() - start < 3


def test_templates_by_broadcast_and_by_join(spark):
    menu = "<div class=x>same <b>words</b> everywhere</div>"
    pages = [(i, f"http://h{i % 2}/{i}", f"<body>{menu if i % 4 else ''}<div>page {i // 2}</div></body>") for i in range(30)]
    pages += [(99, None, None), (99, "http://h1/9", pages[9][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    a = sorted(map(str, H.extract(df).collect()))
    b = sorted(map(str, H.extract(df, broadcast_bytes=-1).collect()))
    assert a == b and len(a) == 32 and not any("everywhere" in x for x in a)
