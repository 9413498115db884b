import datetime as dt
import gzip
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def make_records(spark):
    def make(rows):
        full = [(i, kind, url, None if at is None else T0 + dt.timedelta(seconds=at), status, headers, digest, "x", 1) for i, kind, url, at, status, headers, digest in rows]
        return spark.createDataFrame(full, "record_id string, record_type string, url string, captured_at timestamp, status int, headers map<string,string>, payload_digest string, first string, prior int")

    return make


ROWS = [
    ("a1", "response", "http://WWW.Site.org:80/p/?utm_source=x#top", 10, 200, {"etag": '"1"', "content-type": "text/html", "date": "d1"}, "h1"),
    ("a2", "response", "https://site.org/p", 20, 200, {"etag": '"2"', "content-type": "text/html", "date": "d2"}, "h2"),
    ("v1", "revisit", "http://site.org/p/", 15, 304, {"etag": 'W/"1"', "date": "d3"}, None),
    ("v2", "revisit", "http://site.org/p", 20, 304, {"etag": '"1"'}, None),
    ("v3", "revisit", "http://site.org/p.html", 30, 304, {"etag": '"1"'}, None),
    ("v4", "revisit", "http://site.org/p", 5, 304, {}, "h1"),
    ("v5", "revisit", "http://site.org/p", 31, 304, None, "h2"),
    ("v6", "revisit", "http://other.org/", 31, 304, {}, "h2"),
    ("n1", "revisit", None, 31, 304, {}, "h2"),
    ("n2", "response", "http://site.org/p", None, 200, {}, "h9"),
]


def test_resolution(make_records):
    got = {r["record_id"]: r for r in warc.resolve_revisits(make_records(ROWS)).collect()}
    assert {k: r["resolution"] for k, r in got.items()} == {"a1": "response", "a2": "response", "v1": "resolved", "v2": "resolved", "v3": "mismatch", "v4": "orphan", "v5": "resolved", "v6": "orphan", "n1": "orphan", "n2": "response"}
    assert got["v1"]["source_id"] == "a1" and got["v2"]["source_id"] == "a1" and got["v5"]["source_id"] == "a2"
    assert got["v1"]["final_headers"] == {"etag": 'W/"1"', "content-type": "text/html", "date": "d3"}
    assert (got["v1"]["final_status"], got["v1"]["final_digest"], got["v3"]["final_status"]) == (200, "h1", 304)


def test_slices_of_a_hot_url_agree_with_a_plain_scan(make_records, spark, monkeypatch):
    from tessera.llm.common import Scratch

    rows = [(f"r{i}", "response" if i % 5 == 0 else "revisit", "http://hot.org/", (i * 37) % 400, 200, {}, f"d{i}") for i in range(300)]
    rows += [(f"q{i}", "response" if i % 2 else "revisit", f"http://cold{i // 4}.org/", i, 200, {}, "d") for i in range(40)]
    captures = make_records(rows).select(F.col("url").alias("key"), F.unix_seconds("captured_at").alias("at"), F.col("record_id").alias("tie"), (F.col("record_type") == "response").alias("full"), F.struct("record_id").alias("info"))
    got = {r["tie"]: r["prior"]["info"]["record_id"] if r["prior"] else None for r in warc.latest_before(captures, Scratch(spark, "t"), slice_size=7).collect()}
    for i, kind, url, at, *_ in rows:
        earlier = [(a, j) for j, k, u, a, *_ in rows if k == "response" and u == url and a < at]
        if kind == "revisit":
            assert got[i] == (max(earlier)[1] if earlier else None)


def test_a_file_of_many_members_is_read_in_one_pass():
    one = [warc.record_bytes(f"<{i}>", "response", "http://a.b/", "2024-01-01T00:00:00Z", 200, {}, b"body %d " % i * 20) for i in range(20_000)]
    start = time.perf_counter()
    got = [(r[0], len(r[-1])) for r in warc.parse(b"".join(one)[at : at + warc.CHUNK] for at in [0])]
    assert len(got) > 100
    raw = b"".join(one)
    got = [(r[0], bytes(r[-1])) for r in warc.parse(raw[at : at + warc.CHUNK] for at in range(0, len(raw), warc.CHUNK))]
    assert time.perf_counter() - start < 10
    assert got == [(f"<{i}>", b"body %d " % i * 20) for i in range(20_000)]


@pytest.mark.parametrize("step", [1, 7, 1000, 10**7])
def test_chunks_may_end_anywhere(step):
    rows = [("<a>", "response", "http://a.b/", "2024-01-01T02:00:00+02:00", 200, {"etag": "x"}, b"WARC/1.0\r\n\r\n" * 30), ("<b>", "response", "http://a.b/", "not a time", 200, {}, b""), ("<c>", "response", "u", "2024-01-01", 200, {}, bytes(300_000))]
    for raw in (b"".join(warc.record_bytes(*r) for r in rows), gzip.decompress(b"".join(warc.record_bytes(*r) for r in rows))):
        got = list(warc.parse(raw[at : at + step] for at in range(0, len(raw), step)))
        assert [(r[0], bytes(r[-1])) for r in got] == [(r[0], r[-1]) for r in rows]
        assert [r[3] for r in got] == [T0, None, T0]


def test_files_round_trip(spark, tmp_path):
    rows = [(f"<urn:{i}>", "response", f"http://a.b/{i}", f"2024-01-0{i}T00:00:00Z", 200, {"etag": f'"{i}"'}, b"body \r\n\r\n WARC/1.0 " * i) for i in range(1, 5)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(warc.record_bytes(*r) for r in rows))
    whole = warc.record_bytes(*rows[0])
    (tmp_path / "cut.warc.gz").write_bytes(whole + warc.record_bytes(*rows[1])[:-20])
    got = sorted((r["record_id"], r["url"], r["status"], r["headers"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path / "x.warc.gz")).collect())
    assert got == [(i, u, s, h, p) for i, _, u, _, s, h, p in rows]
    assert [r["record_id"] for r in warc.read_warc(spark, str(tmp_path / "cut.warc.gz")).collect()] == ["<urn:1>"]


def test_payloads_follow_their_source(make_records, spark):
    resolved = warc.resolve_revisits(make_records(ROWS[:3]))
    bodies = spark.createDataFrame([("a1", b"one"), ("a2", b"two"), ("v1", b"")], "record_id string, payload binary")
    assert {r["record_id"]: bytes(r["final_payload"]) for r in warc.with_payloads(resolved, bodies).collect()} == {"a1": b"one", "a2": b"two", "v1": b"one"}


def test_canonical_urls(spark):
    urls = {"HTTP://User@Www.A.org:443/x/index.html?b=1&utm_id=3&ref=q#f": "a.org/x/index?b=1", "https://a.org/?fbclid=1&k=v": "a.org?k=v", "not a url#x": "not a url", "http://a.org:8080/": "a.org:8080"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == urls


def test_empty_table(make_records):
    assert warc.resolve_revisits(make_records([])).collect() == []


def test_query_over_odd_pages(spark, tmp_path):
    spark.createDataFrame([(1, None, None, 0), (None, "http://a.b/", "x", 0), (13, "http://a.b/", "", 0), (2, "http://a.b/", "y", 0)], "page_id long, url string, html string, key int").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["record_id"]: r["resolution"] for r in warc.op4_revisits(spark, str(tmp_path)).collect() if r["record_id"]}
    assert got == {"r1": "response", "v1": "orphan", "r2": "response", "v2": "resolved", "v13": "mismatch"}
