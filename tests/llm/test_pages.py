"""Main text, archive and URL list on small pages."""

import base64
import datetime
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import html_text as h
from reviewlake.llm import url_filter as u
from reviewlake.llm import warc as w

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy our things today, now.</div>
<article><h1>On  stones &amp; rivers</h1><p><b>Stones lie in rivers.<br>They stay&nbsp;there for a long time, as we know.<p>Second, they roll on.</p>
<div class="comments"><div class="comment"><p>Anna</p><p>I liked this text, thanks a lot.</p></div></div></article>
<aside class="sidebar"><h3>More</h3><p>Other posts of ours.</p></aside><form><label>Mail</label><input></form>
<footer>&copy; somebody. All rights reserved.</footer></body></html>"""


def test_article_of_a_page():
    text = h.main_texts([PAGE, None, "", "<nav><a href=x>only links</a></nav>", "<p>unclosed <b>text"], h.default_weights())
    assert text[0] == (
        "On stones & rivers\n\nStones lie in rivers. They stay there for a long time, as we know.\n\nSecond, they roll on."
    )
    assert text[1:4] == ["", "", ""]


P = "The quick brown fox jumps over the lazy dog while the sun sets slowly."
BY_HAND = [
    (f'<div class="content"><div><div><p>{P}</p><p>{P}</p></div></div></div>', [P, P]),
    (f"<center><font><p>{P}</p></font></center>", [P]),
    ("<article><div>Text one</div><div>Text two</div></article>", ["Text one", "Text two"]),
    (f"<article><div><div><p>{P}</p><p>{P}</p></div></div></article>", [P, P]),
    (f'<form id="aspnetForm"><h1>A head</h1><p>{P}</p></form>', ["A head", P]),
    (f"<html><head><title>T</title>{P}<p>{P}</p>", [P, P]),
    (f"<p>{P}</p><textarea>typed words here. And more.</textarea>", [P]),
    (f'<article><p>{P}</p><div style="display: none"><p>{P} Unseen.</p></div></article>', [P]),
    ("<div>" * 30 + f"<p>{P}</p>" + "</div>" * 30, [P]),
    (f"<body>{P}<br><br>{P}</body>", [f"{P} {P}"]),
    (f'<form action="/s"><label>Name</label><input><p>Please send us your name.</p></form><p>{P}</p>', [P]),
    (f'<div><div><p>{P}</p></div></div><div class="comments"><div><p>{P} I agree.</p></div></div>', [P]),
    ("<form><label>Name</label><input><button>Send</button></form>", []),
]


@pytest.mark.parametrize("html, blocks", BY_HAND)
def test_pages_the_composer_can_not_make(html, blocks):
    assert h.main_texts([html], h.default_weights()) == ["\n\n".join(blocks)]


def test_stray_end_tags_take_linear_time():
    start = time.perf_counter()
    tree = h.parse(["<div>" * 2_000 + "</x>" * 8_000 + "<li></li>" * 8_000 + "<p>text"])
    assert time.perf_counter() - start < 2 and tree.text[-1] == "text"


def test_held_out_pages_of_the_composer():
    tree = h.parse(h.labelled_pages(120, seed=1234))
    p, _ = h._Graph(tree).marginals(h.default_weights())
    runs = np.array(tree.kind) == h.TEXT
    assert ((p > 0.5) == h.true_states(tree))[runs].mean() > 0.98


def test_marginals_equal_those_over_all_states():
    from itertools import product

    tree = h.parse(["<div><p>one two</p><ul><li>x</ul></div>"])
    r = np.random.default_rng(0)
    weights = h.Weights(r.normal(size=h.N_FEATURES), r.normal(size=(2, 2, 2)))
    graph, n = h._Graph(tree), len(tree.parent)
    unary, total, ones = graph.unary(weights), 0.0, np.zeros(n)
    for state in product((0, 1), repeat=n):
        score = sum(unary[i] * s for i, s in enumerate(state))
        score += sum(weights.edge[tree.kind[i], state[tree.parent[i]], state[i]] for i in range(n) if tree.parent[i] >= 0)
        total += np.exp(score)
        ones += np.exp(score) * np.array(state)
    assert np.allclose(graph.marginals(weights)[0], ones / total)


def test_text_column_with_odd_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (2, "u", "<p>" + "Long words, here. " * 20_000, "x"), (1, "u", PAGE, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = frame.select("page_id", h.main_text(frame.html).alias("t")).collect()
    assert len(got) == 4 and got[0]["t"] == got[3]["t"] and got[1]["t"] == "" and len(got[2]["t"]) > 300_000
    assert frame.where("false").select(h.main_text(frame.html)).count() == 0


PAGES = [(1, "http://a.b/x", "<p>é</p>"), (2, "http://a.b/y\r\nX: 1", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "z" * 300_000),
         (5, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (None, "u", "alone")]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    w.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    rows = {(r["page_id"], r["payload_bytes"]): r for r in w.read_archive(spark, str(tmp_path / "a")).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert rows[1, 9]["payload_digest"] == sha("<p>é</p>")
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()}
    assert kinds == {
        (1, 9): ("revisit", 2), (2, 9): ("response", None), (None, 9): ("revisit", 2), (3, 0): ("revisit", 4),
        (4, 0): ("response", None), (5, 300_000): ("response", None), (None, 5): ("response", None),
    }
    records = [bytes(r["record"]) for r in w.restore_records(spark, str(tmp_path / "a")).collect()]
    assert len(records) == 8
    assert sorted(r.split(b"\r\n\r\n", 1)[1][:-4] for r in records) == sorted((p[2] or "").encode() for p in PAGES)
    assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") for r in records) and not any(b"\r\nX: 1" in r for r in records)
    w.write_archive(pages.where("false"), str(tmp_path / "b"))
    assert w.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_damaged_payload_is_noticed(spark, tmp_path):
    w.write_archive(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("digest", "response", "cast('other' as binary) payload")
    bad.write.parquet(str(tmp_path / "c/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "c/records"))
    with pytest.raises(Exception, match="does not match its digest"):
        w.read_archive(spark, str(tmp_path / "c")).collect()


def test_urls_against_the_list_of_their_day(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = [
        ("domain:x.org", "block", day(5)), ("host:a.x.org", "allow", day(8)), ("path:a.x.org/bad", "block", day(10)),
        ("path:a.x.org/bad", "remove", day(12)), ("domain:x.org", "remove", day(20)), (None, "block", day(1)),
        ("domain:y.org", None, day(1)), ("domain:x.org", "block", day(5)),
    ]
    urls = {"p": "https://u@a.x.org:8/bad/q", "h": "http://A.X.org./", "d": "http://b.x.org", "n": None, "o": "no url", "y": "http://y.org"}
    rows = [(i * 100 + n, k, url, day(n), "c") for i, (k, url) in enumerate(urls.items()) for n in (4, 5, 9, 11, 12, 20)]
    rows += [rows[1], (None, "d", urls["d"], day(6), "c"), (999, "d", urls["d"], None, "c")]
    captures = spark.createDataFrame(rows, "page_id long, k string, url string, fetched date, key string")
    got = u.filter_urls(captures, spark.createDataFrame(entries, "key string, action string, day date")).collect()
    assert len(got) == len(rows)
    verdicts = {(r["page_id"], r["fetched"]): r["verdict"] for r in got}
    line = lambda i: [verdicts[i * 100 + n, day(n)] for n in (4, 5, 9, 11, 12, 20)]
    assert line(0) == ["unlisted", "blocked", "allowed", "blocked", "allowed", "allowed"]
    assert line(1) == ["unlisted", "blocked", "allowed", "allowed", "allowed", "allowed"]
    assert line(2) == ["unlisted", "blocked", "blocked", "blocked", "blocked", "unlisted"]
    assert set(line(3) + line(4) + line(5)) == {"unlisted"}
    assert verdicts[None, day(6)] == "blocked" and verdicts[999, None] == "unlisted"
    none = u.filter_urls(captures.where("false"), spark.createDataFrame([], "key string, action string, day date"))
    assert none.count() == 0


def test_registered_domains(spark):
    hosts = {"a.example.co.uk": "example.co.uk", "co.uk": "co.uk", "www.x.com.br": "x.com.br", "10.1.2.3": "10.1.2.3", "x": "x",
             "b.c.de": "c.de", "a.com": "a.com", "www.co.com": "co.com", "1.2.3.example.org": "example.org"}
    frame = spark.createDataFrame([(k, v) for k, v in hosts.items()], "host string, want string")
    got = frame.select("host", "want", u.domain_of(F.col("host")).alias("got")).collect()
    assert {r["host"]: r["got"] for r in got} == hosts
    urls = {"http://[::1]:80/a/b": "[::1]", "http://u:p@10.0.0.1:8/x": "10.0.0.1", "https://A.co.UK.:1": "a.co.uk", "http://[": None}
    frame = spark.createDataFrame([(k,) for k in urls], "url string")
    keys = {r["url"]: r for r in frame.select("url", u.host_of(F.col("url")).alias("h"), u.url_keys(F.col("url")).alias("k")).collect()}
    assert {k: r["h"] for k, r in keys.items()} == urls
    assert [k["key"] for k in keys["http://[::1]:80/a/b"]["k"]] == ["path:[::1]/a", "host:[::1]", "domain:[::1]"]


def test_captures_of_one_host_and_repeated_ones(spark):
    captures = spark.range(30_000).selectExpr("id % 29000 AS page_id", "'http://h.org/a/b' AS url", "date'2024-01-05' AS fetched")
    entries = spark.createDataFrame([("host:h.org", "block", datetime.date(2024, 1, 1))], "key string, action string, day date")
    got = u.filter_urls(captures, entries)
    assert got.count() == 30_000 and got.where("verdict = 'blocked' AND matched = 'host:h.org'").count() == 30_000


def test_records_of_one_payload_are_rebuilt_in_copies(spark, tmp_path):
    pages = spark.range(3_000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, concat('p', id), 'shared') AS html")
    w.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 1_001
    rows = w.read_archive(spark, str(tmp_path / "a"))
    assert rows.count() == 3_000 and rows.select("page_id").distinct().count() == 3_000
    assert rows.where("record_type = 'revisit'").select("refers_to").distinct().collect() == [(2_999,)]
    records = w.restore_records(spark, str(tmp_path / "a")).join(pages, "page_id")
    assert records.where("substring_index(decode(record, 'UTF-8'), '\r\n\r\n', 2) LIKE concat('%\n', html)").count() == 3_000


def test_record_that_differs_from_its_header_is_noticed(spark, tmp_path):
    w.write_archive(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"), str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(tmp_path / "c/payloads"))
    records = spark.read.parquet(str(tmp_path / "a/records"))
    short = F.encode(F.replace(F.decode("header", "UTF-8"), F.lit("Content-Length: 9"), F.lit("Content-Length: 8")), "UTF-8")
    records.withColumn("header", short).write.parquet(str(tmp_path / "c/records"))
    with pytest.raises(Exception, match="header and payload differ"):
        w.read_archive(spark, str(tmp_path / "c")).collect()
