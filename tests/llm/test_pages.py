"""HTML extraction and WARC round trips."""

from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from bitspark.llm import html_main, warc

NAV = "<nav><a href=/>Home</a> <a href=/b>Blog about many things and more</a></nav>"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}{body}<footer>&copy; all of us here</footer></body></html>"


def text_of(html: str) -> str:
    found = html_main.blocks(html)
    return html_main.settle(found, [0.0] * len(found)) or ""


@pytest.mark.parametrize(("body", "want"), [
    ("<article><h1>A &amp; B</h1><p>one\n two<p>three<br>four</article>", "A & B\n\none two\n\nthree four"),
    ("<article><p><b>bold<br><p>next</p></article>", "bold\n\nnext"),
    ("<article>bare <i>text</i>!<ul><li>x<li>y</ul></article>", "bare text!\n\nx\n\ny"),
    ("<article><p>a</p><div class='ad'>buy</div><aside>side</aside><form>f<input></form><p>b</p></article>", "a\n\nb"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>a</p><footer>f</footer></article>", "T\n\na"),
    ("<article><p>a</p><section id=comments><p>first!</p></section><article>reply</article></article>", "a"),
    ("<div class='sidebar x'>s</div><article><p>a<!-- no --> b&nbsp;c &lt;d&gt; &#233;&#x41;</p></article><div id=cookie-notice>c</div>", "a b c <d> éA"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><p title='a>b'>q</p><noscript>n</noscript><p hidden>h</p></article>", "q"),
    ("<article><p><span class=share>share me</span> kept</p></article>", "kept"),
    ("<article><p>a <span class=ad>buy <span>more</span> now</span> b</p><p>c</p></article>", "a\n\nb\n\nc"),
    ("<article><p>a<span class=ad>buy<p>b</article>", "a\n\nb"),
    ("<article><p>a</p><div class='sideBar'>s</div><div id=side-bar>t</div><div class='userComments'>u</div><p class='lead important'>b</p></article>", "a\n\nb"),
    ("<div class='page with-sidebar'><article><p>whole</p><div class=ad>x</div></article></div>", "whole"),
    ("<div class='related'><article>other</article></div><article>own</article>", "own"),
    ("<article><ul><li>x<li>y<p>z</ul>tail<hr>end</article>", "x\n\ny\n\nz\n\ntail\n\nend"),
])
def test_article_blocks(body, want):
    assert text_of(page(body)) == want


@pytest.mark.parametrize("attribute", ["id=search-algorithms", "id=related-work", "id='share-price'", "class=skip-lists", "class='table-header'", "id=code-comments", "class=no-comments", "class='menu-planning notes'"])
def test_slugs_inside_an_article_are_no_furniture(attribute):
    assert text_of(page(f"<article><p>a</p><section {attribute}><h2>H</h2><p>b</p></section><p>c</p></article>")) == "a\n\nH\n\nb\n\nc"
    assert text_of(page(f"<main><article><p>a</p></article></main><div {attribute}>out</div>")) == "a"


def test_whole_names_inside_an_article_are_furniture():
    for attribute in (
        "class=share", "id=comments", "class='x related'", "class=user-comments", "class=right-sidebar", "id=side-bar", "class=ad-container", "class='x top-ads-banner'", "class=cookie-banner", "class=cookieNotice", "class=share-links",
        "class=social-icons", "class=related-posts", "class=more-stories", "class=search-form", "class=consent", "class=privacy-notice", "class=adSlot",
    ):
        assert text_of(page(f"<article><p>a</p><div {attribute}>out</div></article>")) == "a", attribute


@pytest.mark.parametrize("part", [
    "<h2 id=search>x</h2>", "<h2 id=notice>x</h2>", "<p id=share>x</p>", "<h3 id=comments>x</h3>", "<div class=alert>x</div>", "<div class=header>x</div>", "<div class=overlay>x</div>", "<p class=notice>x</p>", "<div id=search>x</div>", "<li id=related>x</li>",
    "<div class='cookie-recipe'>x</div>", "<p class='ad-hoc'>x</p>", "<div class='social-history'>x</div>", "<section id=ad><p>x</p></section>", "<div class='header-image more'>x</div>",
])
def test_an_article_keeps_parts_of_its_own(part):
    """Slugs of one word, and names that articles use for warnings and titles, stay unless the host repeats what they hold."""
    assert text_of(page(f"<article><p>a</p>{part}<p>b</p></article>")) == "a\n\nx\n\nb"


def test_tags_after_many_open_quotes_still_end_rightly():
    """However many tags were ended early for a quote that never closes, a later one's closed quotes may hold an angle bracket."""
    assert text_of("<article>" + "<p title='a>b'>q</p>" * 50 + "<p title='open>r</p></article>") == "\n\n".join(["q"] * 50 + ["r"])
    assert text_of("<article>" + "<p title=\"it's>a</p><p title=\"x>y\">b</p>" * 40 + "</article>").endswith("b")
    many = "<article>" + "<p title='x\">n</p>" * 40  # an even number of single quotes: they close each other
    assert "title" not in text_of(many + "</article>")


TRUTHS = [
    # (markup of a page's body, its main text)
    ("<header><h1>Site</h1></header><main><article><h1>T</h1><p>one</p></article></main>", "T\n\none"),
    ("<div id=page><div id=header>Site</div><div id=content><article><h2>T</h2><div class=byline>by A</div><p>one</p></article></div><div id=footer>f</div></div>", "T\n\nby A\n\none"),
    ("<article><h1>T</h1><p>one</p><div class=share-buttons><a>Tweet</a></div><p>two</p><section class=comments><article>no</article></section></article>", "T\n\none\n\ntwo"),
    ("<div class=cookie-banner>We use cookies</div><article><p>one</p></article>", "one"),
    ("<article><p>one</p><div class=ad-container>Buy shoes</div><p>two</p></article><div class=related-posts>more</div>", "one\n\ntwo"),
    ("<article><ul class=breadcrumbs><li>a</li></ul><h1>T</h1><p>one</p></article>", "T\n\none"),
    ("<article><h1>T</h1><nav class=toc><a>1</a></nav><h2 id=search>Search</h2><p>one</p><h2 id=notice>Notice</h2><p>two</p></article>", "T\n\nSearch\n\none\n\nNotice\n\ntwo"),
    ("<article><table><tr><th>k<th>v<tr><td>1<td>2</table></article>", "k\n\nv\n\n1\n\n2"),
    ("<article><p>a &lt;b&gt; &amp;amp; &quot;c&quot; &nbsp; d</p></article>", "a <b> &amp; \"c\" d"),
    ("<article><pre>x\n  y</pre><blockquote><p>q</p></blockquote></article>", "x y\n\nq"),
    ("<article><figure><img src=x alt=no><figcaption>cap</figcaption></figure><p>one</p></article>", "cap\n\none"),
    ("<article><p>one<script>var a = '<p>no</p>';</script> more</p><style>p{}</style></article>", "one more"),
    ("<article><p>one</p><form><label>Mail</label><input><button>Go</button></form></article>", "one"),
    ("<article><div class=alert><b>Warning:</b> hot</div><p>one</p></article>", "Warning: hot\n\none"),
    ("<article><p>one</p><!-- <p>no</p> --><p>two</p></article>", "one\n\ntwo"),
    ("<div role=navigation>n</div><div role=main><p>one</p></div><div role=contentinfo>f</div>", "one"),
    ("<article><p>first<p>second<div>third<p>fourth</div></article>", "first\n\nsecond\n\nthird\n\nfourth"),
    ("<article><h1>T</h1><div class=widget>w</div><div aria-hidden=true>h</div><p>one</p><aside>s</aside></article>", "T\n\none"),
    ("<article><dl><dt>t<dd>d</dl><p>one<hr>two</p></article>", "t\n\nd\n\none\n\ntwo"),
    ("<article><p>caf&eacute; na&iuml;ve &#x1F600; &unknown;</p></article>", "café naïve 😀 &unknown;"),
]


def test_hand_made_truths(spark):
    """Whole extraction of pages whose main text was written down by hand."""
    rows = [(k, f"http://h{k}.example/", page(body)) for k, (body, _) in enumerate(TRUTHS)]
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [got[k] for k in range(len(TRUTHS))] == [t for _, t in TRUTHS]


@pytest.mark.parametrize(("body", "want"), [
    ("<div class='no-sidebar'><main><p>m</p></main></div>", "m"),
    ("<form><main><p>m</p><input></main></form>", "m"),
    ("<div class='content-with-sidebar'><main><p>m</p></main><aside>s</aside></div>", "m"),
    ("<div class='sidebar'><div role=main><p>m</p></div></div>", "m"),
    ("<article><div class='article-header'><h1>T</h1></div><p class='share-price'>9</p></article>", "T\n\n9"),
    ("<article><p>a</p><script src=//x/>var leak = 1;</script><p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><svg width=1 /><p>b</p></article>", "a\n\nb"),
    ("<article><p title=\"open>a</p><p>b</p></article>", "a\n\nb"),
    ("<article><p>teaser</p></article><main><p>" + "long text of its own " * 20 + "</p></main>", ("long text of its own " * 20).strip()),
    ("<article><p>short</p></article><main><p>shorter</p></main>", "short"),
])
def test_wrappers_and_containers(body, want):
    found = html_main.blocks(f"<html><body>{body}</body></html>")
    assert (html_main.settle(found, [0.0] * len(found)) or "") == want


def test_math_stays():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='application/x-tex'>x=2</annotation></semantics></math>"
    assert text_of(page(f"<article><p>where {formula} holds</p></article>")) == "where x=2 holds"


def test_odd_markup_does_not_fail():
    for html in ("", "<", "<<<>>>", "<p", "</article></p>", "<!--", "<![CDATA[x", "<script>", "a < b > c", "<article" * 2000, "<div>" * 3000 + "x", "<a b='" + "x" * 5000):
        html_main.blocks(html)


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>" * 100_000 + "</span>" * 100_000, "<p class=ad><span class=ad>" * 20_000 + "</b>" * 50_000, "<a b=\"'>" * 100_000, "<a b='\">" * 100_000 + "'", "<!--" * 200_000, "<script>" * 100_000,
    "<" * 1_000_000, "<article>" * 100_000 + "x" + "</article>" * 100_000, "<h1>" * 100_000, "<![CDATA[" * 100_000, "</p" * 300_000, "&#x41;" * 100_000, "<a " + "b='c' " * 150_000,
], ids=range(14))
def test_markup_is_read_in_linear_time(page):
    import time

    began = time.process_time()
    html_main.blocks(page)
    assert time.process_time() - began < 5


def test_repeats_decide_doubtful_blocks(spark):
    """A class that only resembles furniture goes where other pages of the host repeat its text, and stays where they don't."""
    line = "subscribe to our letter and get all of our stories by mail every week"
    body = "<article><p>article {0} about its own matter m{0}</p><div class='article-subscribe-box'>{1}</div><p>end {0}</p></article>"
    rows = [(k, "http://a.example/x", page(body.format(k, line))) for k in range(3)] + [(10 + k, f"http://b{k}.example/x", page(body.format(k, line))) for k in range(3)]
    rows += [(20, "http://a.example/y", page(body.format(20, "a box with words of its own that no other page has")))]
    # repeats outside articles decide which open text is the page's own, and whether a short article gives way to it
    own = "w{0} v{0} u{0} t{0} s{0} r{0} q{0} p{0} are words that only page {0} has"
    rows += [(30 + k, "http://c.example/x", f"<html><body><div>{line} and {line}</div><article>teaser</article><div>{own.format(k) if k else ''}</div></body></html>") for k in range(3)]
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()}
    for k in range(3):
        assert got[k] == f"article {k} about its own matter m{k}\n\nend {k}"
        assert line in got[10 + k]
    assert "words of its own" in got[20]
    assert got[31] == own.format(1) and got[32] == own.format(2) and got[30] == "teaser"


def test_main_text(spark):
    plain = "<html><body><div>Site wide banner text that is on every page of it</div><div>{}</div></body></html>"
    rows = [(1, "http://h.example/1", page("<article><p>same words in two pages of one host here</p></article>")), (2, "http://h.example/2", page("<article><p>same words in two pages of one host here</p></article>"))]
    rows += [(10 + k, "http://plain.example/x", plain.format(f"page {k} has its very own words w{k} v{k} u{k} and x{k}")) for k in range(4)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://h.example/3", page("")), (10, "http://plain.example/x", plain.format("page 0 has its very own words w0 v0 u0 and x0")), (None, "http://z.example", page("<article>n</article>"))]
    rows += [(30, "http://m.example", "<main><p>m</p></main>"), (31, "http://long.example", page("<article><p>" + "word " * 50_000 + "</p></article>"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit("x").alias("host"), F.lit("y").alias("text"), F.lit(1).alias("row")).repartition(3)
    got = html_main.extract_main(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[1].text == by[2].text == "same words in two pages of one host here"  # an article stays, repeated or not
    for k in range(4):
        assert "banner" not in by[10 + k].text and f"w{k} v{k} u{k} and x{k}" in by[10 + k].text
    assert by[20].text == by[21].text == by[22].text == "" and by[None].text == "n" and by[30].text == "m" and by[31].n_chars == 5 * 50_000 - 1
    assert html_main.extract_main(df.where("false")).count() == 0


def test_repeats_equal_a_suffix_array(spark):
    """Buckets by first tokens find the coverage that adjacent entries of a sorted suffix array give."""
    import random

    r = random.Random(4)
    streams = [[f"t{r.randrange(6)}" for _ in range(40)] for _ in range(6)]
    streams[3][5:20] = streams[1][10:25]
    length = 6
    suffixes = sorted((tuple(s[i:]), k, i) for k, s in enumerate(streams) for i in range(len(s)))
    covered = [set() for _ in streams]
    for x in range(len(suffixes)):
        for y in range(x + 1, len(suffixes)):
            same = 0
            for p, q in zip(suffixes[x][0], suffixes[y][0], strict=False):
                if p != q:
                    break
                same += 1
            if same < length:
                break
            if suffixes[x][1] != suffixes[y][1]:
                for _, k, i in (suffixes[x], suffixes[y]):
                    covered[k].update(range(i, i + same))
    pages = [(k, "http://one.example", f"<div>{' '.join(s)}</div>") for k, s in enumerate(streams)]
    got = {r.page_id: r.text for r in html_main.extract_main(spark.createDataFrame(pages, "page_id int, url string, html string"), min_tokens=length).collect()}
    for k, s in enumerate(streams):
        assert got[k] == " ".join(t for i, t in enumerate(s) if i not in covered[k])


# ---------------------------------------------------------------- WARC

PAGES = [
    (5, "http://a.example/x?q=1", "<p>same</p>"), (3, "http://a.example/y", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://b.example", "été\r\n\r\nWARC/1.1\r\nline\0"),
    (6, "http://c.example/\r\nSet: x", ""), (7, "http://d.example", None), (8, "ftp://e", "x" * 200_000), (3, "http://a.example/y", "<p>same</p>"), (None, "http://n.example", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "w")
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").select("*", F.lit("c").alias("digest"), F.lit(1).alias("first"))
    warc.write_warc(df, path, captures_per_file=2)
    return path


def test_transactions(spark, archive):
    got = warc.assemble(warc.read_warc(spark, archive, payloads=True)).collect()
    assert len(got) == len(PAGES)
    first = {}
    for d, _, h in PAGES:
        if d is not None:
            first[h or ""] = min(d, first.get(h or "", d))
    seen = []
    for r in got:
        c = r.capture
        html = next(h or "" for d, _, h in PAGES if d == c.page_id)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        again = c.page_id is not None and c.page_id > first[html]
        assert c.type == ("revisit" if again else "response") and c.payload_digest == digest
        assert r.request is not None and "HTTP/1.1" in r.request.fields and f"payloadBytes: {len(html.encode())}" in r.metadata.fields
        if again:
            assert r.original.page_id == first[html] and r.original.payload_bytes == len(html.encode()) and c.payload is None
        else:
            assert bytes(c.payload).decode() == html and c.payload_bytes == len(html.encode()) and r.original is None
        seen.append(c.page_id)
    assert sorted(map(str, seen)) == sorted(str(d) for d, *_ in PAGES)


def test_query_returns_every_request_and_metadata(spark, sf):
    from bitspark.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    df = queries.op2_warc_transactions(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and "concurrent_to" in plan
    got = df.collect()
    assert len(got) == len(pages)
    for r in got:
        host, _, path = pages[r.page_id].url.partition("://")[2].partition("/")
        assert r.request == f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n" and r.metadata == f"payloadBytes: {len(pages[r.page_id].html.encode())}\r\n"
    assert len({r.request_id for r in got} | {r.metadata_id for r in got}) == 2 * len(pages)


def test_archives_of_other_makers(spark, tmp_path):
    """One gzip member for each record, one for all, none at all, and records cut anywhere over the pieces."""
    import gzip

    def record(k, kind, block, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nwarc-record-id:<r%d>\r\nX: a\r\n b\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, k, extra, len(block), block)

    records = [record(0, b"warcinfo", b"software: x"), record(1, b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"\r\n\r\nWARC/1.0\r\n" * 5), record(2, b"response", b"HTTP/1.1 200 OK\r\n\r\n"), record(3, b"metadata", b"m", b"WARC-Concurrent-To: <r1>\r\n")]
    for name, data in (("each", b"".join(map(gzip.compress, records))), ("all", gzip.compress(b"".join(records))), ("plain", b"".join(records))):
        (tmp_path / name).write_bytes(data)
        for step in (1, 7, 1 << 16):
            assert [h["warc-type"] for h, _ in warc.parse_records(warc.inflated(data, step))] == [["warcinfo"], ["response"], ["response"], ["metadata"]]
        got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / name)).collect()}
        assert len(got) == 4 and got["<r1>"].payload_bytes == 70 and got["<r2>"].payload_bytes == 0 and got["<r3>"].concurrent_to == ["<r1>"] and got["<r1>"].page_id is None
    assert list(warc.parse_records(iter([b"", b""]))) == []
    for broken in (gzip.compress(records[0])[:-9], records[0][:-2], b"WARC", b"junk!", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(warc.inflated(broken)))


def test_bytes_that_are_no_utf8_and_both_ways_to_name_a_transaction(spark, tmp_path):
    """Requests in Latin-1, several concurrent-to headers, responses that name their request, records without id or type."""

    def record(kind, name, block, *more):
        lines = [b"WARC/1.1", *([b"WARC-Type: " + kind] if kind else []), *([b"WARC-Record-ID: " + name] if name else []), *more, b"Content-Length: %d" % len(block)]
        return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    data = b"".join([
        record(b"request", b"<q1>", b"GET /caf\xe9 HTTP/1.1\r\n\r\n", b"WARC-Target-URI: http://h/\xe9", b"WARC-Concurrent-To: <r1>", b"WARC-Concurrent-To: <r2>"), record(b"response", b"<r1>", http + b"one"),
        record(b"response", b"<r2>", http + b"two\xff"), record(b"response", b"<r3>", http + b"three", b"WARC-Concurrent-To: <q3>", b"WARC-Concurrent-To: <m3>", b"WARC-Page-ID: x"), record(b"request", b"<q3>", b"GET /3"), record(b"metadata", b"<m3>", b"a: \xe9"),
        record(b"response", b"", http + b"no id", b"WARC-Concurrent-To: <q3>"), record(b"", b"<n>", b"no type"), record(b"request", b"<q4>", b"", b"WARC-Concurrent-To: <r3>"),
    ])
    (tmp_path / "a.warc").write_bytes(data)
    records = warc.read_warc(spark, str(tmp_path), payloads=True)
    assert records.count() == 9 and records.where("record_id = '<q1>'").first().uri == "http://h/\ufffd"
    got = {r.capture.record_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", None}
    assert got["<r1>"].request.record_id == got["<r2>"].request.record_id == "<q1>" and got["<r1>"].request.fields == "GET /caf\ufffd HTTP/1.1\r\n\r\n"
    assert bytes(got["<r2>"].capture.payload) == b"two\xff" and got["<r1>"].metadata is None
    assert got["<r3>"].request.record_id == "<q3>" and got["<r3>"].metadata.fields == "a: \ufffd" and got["<r3>"].capture.page_id is None
    assert got[None].request is None


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    sizes = [10] * 60 + [900] * 9 + [3000, 5000, 9000, 0]
    df = spark.createDataFrame([(k, "http://h", chr(97 + k % 26) * n + str(k)) for k, n in enumerate(sizes)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"), captures_per_file=40)
    import gzip

    got = []
    for f in (tmp_path / "w").glob("part-*"):
        found = [len(b) for h, b in warc.parse_records([gzip.decompress(f.read_bytes())]) if h["warc-type"] == ["response"]]
        got += found
        assert len(found) == 1 or len(found) <= 40 and sum(found) <= 4000 + 100 * len(found)
    assert len(got) == len(sizes)
    assert warc._size_classes(1) == [(1 << 31, 1)] and warc._size_classes(1024)[-1] == (1 << 31, 1)


def test_headers_are_single_lines(archive, spark):
    uris = [r.uri for r in warc.read_warc(spark, archive).select("uri").collect()]
    assert "http://c.example/%0D%0ASet: x" in uris and None in uris


def test_small_payloads_are_not_deduplicated(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), dedupe_from=12)
    assert warc.read_warc(spark, str(tmp_path / "w")).where("type = 'revisit'").count() == 0


def test_lone_records(spark):
    fields = "record_id string, type string, concurrent_to array<string>, refers_to string, page_id bigint, uri string, date string, payload_bytes bigint, payload_digest string, fields string, payload binary"
    rows = [("r1", "response", None, None, 1, None, None, 2, "d", None, None), ("q2", "request", ["r1"], None, 1, None, "b", None, None, "2", None), ("q1", "request", ["r1"], None, 1, None, "a", None, None, "1", None),
            ("m1", "metadata", ["gone"], None, 1, None, None, None, None, "x", None), ("v1", "revisit", None, "gone", 2, None, None, None, "d", None, None)]
    got = {r.capture.record_id: r for r in warc.assemble(spark.createDataFrame(rows, fields)).collect()}
    assert set(got) == {"r1", "v1"} and got["r1"].request.record_id == "q1" and got["r1"].metadata is None and got["v1"].original is None
    assert warc.assemble(spark.createDataFrame([], fields)).count() == 0


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_base32(spark):
    import duckdb

    from bitspark.llm.queries import WARC_SQL

    con = duckdb.connect()
    con.sql("create table pages as select * from (values (1, 'a'), (2, 'é'), (3, 'a'), (4, null)) t(page_id, html), (select 'http://h/p' as url)")
    got = {r[0]: r for r in con.sql(WARC_SQL).fetchall()}
    for k, h in ((1, "a"), (2, "é"), (3, "a"), (4, "")):
        assert got[k][2] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert got[3][3:5] == ("revisit", 1) and got[3][6] == "GET /p HTTP/1.1\r\nHost: h\r\n\r\n"
