"""Template removal, archives and temporal URL lists."""

import datetime
import io

import pytest
from pyspark.sql import functions as F

from celstack.llm import templates, url_filter, warc

CLASHING = "text string, host string, page long, digest string, bucket long, hit string, refers_to long"


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "t", "h", 1, "d", 2, "x", 3) for r in rows], f"page_id long, url string, html string, {CLASHING}").repartition(2)

    return make


def text_of(source, gone=frozenset()):
    return templates.Page(source, gone).text


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &amp; simple", "plain & simple"),
    ("<article><h1>T</h1><p><b>One<br><p>Two\n  three</article>", "T One Two three"),
    ("<nav>menu</nav><main><p>a</p><aside>side</aside><form>f</form></main><footer>x</footer>", "a"),
    ("<article><p>in<b>li</b>ne &eacute;&#x20AC;&nbsp;x</p><script>var a = '</p>';</script></article>", "inline é€ x"),
    ("<div class='cookie-notice'>c</div><div><p>body <div class=ad>buy</div> text</div>", "body text"),
    ("<article><h1>A</h1><p>main</p><section id=comments><article><p>reader</p></article></section></article><article>teaser</article>", "A main"),
    ("<article><header><h1>T</h1></header><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "T a b 1 2"),
    ("<article><p>kept<!-- no --> <p hidden>gone</p> end <p cut", "kept end"),
    ("<header>site</header><p>x < y and z</p>", "x < y and z"),
])
def test_rules(source, text):
    assert text_of(source) == text


def test_deep_and_broken_pages_end():
    assert text_of("<div>" * 20_000 + "deep") == "deep"
    assert text_of("</p>" * 1000 + "<" * 1000) == "<" * 1000
    assert len(text_of("<p>a<b>" * 5000)) == 9999


def test_templates_are_counted_by_host_and_article(pages):
    box = "<div class='x'>Read our other stories</div>"
    rows = [(k, f"http://a.org/{k}", f"<body><article><p>text {k}</p>{box}<section><p>para</p></section></article></body>") for k in range(6)]
    rows += [(10 + k, "http://b.org/", f"<body><article><p>copy</p>{box}</article></body>") for k in range(20)]  # one article, twenty times
    rows += [(40, None, None), (41, "http://a.org/0", "")]
    got = {r["page_id"]: r for r in templates.extract(pages(rows), min_pages=5).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["text"] == f"text {k}" and got[k]["n_templates"] == 2 for k in range(6))
    assert all(got[10 + k]["text"] == "copy Read our other stories" for k in range(20))
    assert got[40]["text"] == got[41]["text"] == ""
    assert templates.extract(pages([])).count() == 0


def test_archives_round_trip(pages):
    rows = [(1, "http://a/\r\nX: y", "same"), (7, "http://b/é", "same"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300_000), (7, "http://b/é", "same"),
            (None, "n", "same"), (9, "u", "ünï"), (12, "u", "tiny")]
    archives = warc.write_archives(pages(rows), archive_bytes=2000)
    assert archives.count() > 1 and archives.agg(F.sum("records")).first()[0] == len(rows)
    assert archives.count() > 1 < warc.read_archives(archives).rdd.getNumPartitions()
    got = warc.read_archives(archives, payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["record_type"] == "response":
            assert warc.payload_digest(bytes(r["payload"])) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr)
    assert kinds == sorted([(1, "revisit", 7, 4), (7, "response", None, 4), (7, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0),
                            (5, "response", None, 300_000), (None, "response", None, 4), (9, "response", None, 5), (12, "response", None, 4)], key=repr)
    with open(got[0]["archive"].removeprefix("file:").replace("///", "/"), "rb") as file:  # any record can be read at its offset
        data = file.read()
    records = list(warc.read_records(io.BytesIO(data)))
    assert got[0]["offset"] in [o for o, _ in records] and data[:4] == b"\x5d\x2a\x4d\x18"
    assert b"\r\nX: y" not in b"".join(r for _, r in records)
    empty = warc.write_archives(pages([]))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_small_payloads_are_all_responses(pages):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archives(warc.write_archives(pages(rows), min_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_damaged_records_are_refused():
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"\0" * 16)))


def test_temporal_list(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    entries = [("domain", "bad.org", "block", day(10)), ("domain", "bad.org", "remove", day(100)), ("domain", "bad.org", "block", day(300)),
               ("host", "www.bad.org", "allow", day(50)), ("prefix", "www.bad.org/x", "block", day(60)), ("host", "same.org", "allow", day(5)), ("host", "same.org", "block", day(5)),
               (None, "bad.org", "block", day(0)), ("host", None, "block", day(0)), ("host", "late.org", "block", None)]
    urls = ["http://bad.org/", "https://user@www.BAD.org:80/x/y?q#f", "http://www.bad.org/xx", "http://same.org", "http://notbad.org/", "http://late.org/", "mailto:x", "", None]
    captures = [(k, u, day(t)) for k, u in enumerate(urls) for t in (0, 10, 55, 99, 100, 200, 300, 400)] + [(50, urls[0], None), (51, urls[0], day(20)), (51, urls[0], day(20))]
    listed = spark.createDataFrame(entries, "kind string, pattern string, action string, listed_at timestamp")
    asked = spark.createDataFrame([(*c, "v", "p") for c in captures], "page_id long, url string, fetched_at timestamp, verdict string, pattern string")

    def wanted(url, when):
        best = None
        for kind, pattern in {(e[0], e[1]) for e in entries if e[0] and e[1]}:
            rest = (url or "").split("://", 1)[-1].split("#")[0].split("?")[0] if "://" in (url or "") else ""
            host = rest.split("/")[0].split("@")[-1].split(":")[0].lower()
            path = "/".join([host, *[s for s in rest.split("/")[1:] if s]])
            fits = host == pattern if kind == "host" else ("." + host).endswith("." + pattern) if kind == "domain" else (path + "/").startswith(pattern + "/")
            past = [(e[3], e[2]) for e in entries if (e[0], e[1]) == (kind, pattern) and e[3] and when and e[3] <= when]
            if host and fits and past and max(past)[1] != "remove":
                rank = ({"domain": 0, "host": 1, "prefix": 2}[kind], len(pattern))
                best = max(best or (rank, ""), (rank, max(past)[1]))
        return "blocked" if best and best[1] == "block" else "allowed"

    for bucket in (86400, 30 * 86400, 10_000 * 86400):
        got = sorted((r["page_id"], r["fetched_at"] or day(-1), r["verdict"]) for r in url_filter.filter_captures(asked, listed, bucket).collect())
        assert got == sorted((k, t or day(-1), wanted(u, t)) for k, u, t in captures)
    assert url_filter.filter_captures(asked.limit(0), listed).count() == 0
    assert url_filter.filter_captures(asked, listed.limit(0)).where("verdict = 'blocked'").count() == 0


def test_prefixes_of_any_depth_decide(spark):
    day = datetime.datetime(2024, 1, 1)
    entries = [("host", "a.org", "allow", day), ("prefix", "a.org/1/2/3/4/5/6", "block", day), ("prefix", "a.org/1/2/3/4/5/6/7/8/9", "allow", day)]
    urls = {"http://a.org/1/2/3/4/5": "allowed", "http://a.org/1/2/3/4/5/6": "blocked", "http://a.org/1/2/3/4/5/6/7?q": "blocked", "http://a.org/1/2/3/4/5/6/7/8/9/10": "allowed",
            "http://a.org/1/2/3/4/5/66": "allowed"}
    listed = spark.createDataFrame(entries, "kind string, pattern string, action string, listed_at timestamp")
    asked = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    assert {r["url"]: r["verdict"] for r in url_filter.filter_captures(asked, listed).collect()} == urls


def test_containers_shared_by_some_articles_stay(pages):
    """A text reposted under five headlines and a list in five of forty articles stay; a box that also stands beside articles goes."""
    box, told = "<div>our stories</div>", "<ul><li>told five times</li></ul>"
    rows = [(k, "http://a.org/", f"<body><article><h1>head {k}</h1><div>one body</div></article></body>") for k in range(5)]
    rows += [(10 + k, "http://a.org/", f"<body><article><h1>t</h1><p>text {k}</p>{told if k < 5 else ''}{box if k < 2 else ''}</article>{box if k < 8 else ''}</body>") for k in range(40)]
    rows += [(60 + k, "http://b.org/", f"<body><h1>bare {k}</h1>{told if k < 5 else ''}</body>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in templates.extract(pages(rows)).collect()}
    assert all(got[k] == f"head {k} one body" for k in range(5))
    assert all(got[10 + k] == f"t text {k}" + " told five times" * (k < 5) for k in range(40))
    assert all(got[60 + k] == f"bare {k}" + " told five times" * (k < 5) for k in range(20))
