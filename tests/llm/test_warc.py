import glob
import gzip
import hashlib
from datetime import datetime, timezone

from corpusloom.llm import warc as W


def want(rows):
    out = []
    best = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            best[body] = max(best.get(body, page), page)
    for page, _, html in rows:
        body = (html or "").encode()
        first = best.get(body)
        revisit = first is not None and page != first
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long, longer = "é" * 500, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 50
    rows = [(i, f"http://a/{i}", long) for i in range(40)] + [(100 + i, "http://b", longer) for i in range(3)]
    rows += [(200, None, None), (201, "http://c\r\nX: y", ""), (202, "http://d", "x" * 999), (203, "http://d", "x" * 999), (204, "http://e", "x" * 1000), (205, "http://e", "x" * 1000)]
    rows += [(300, "http://f", "z" * 2_000_000), (39, "http://again", long), (None, "http://n", long), (None, "http://m", "q" * 1500), (None, "http://m", "q" * 1500)]
    frame = spark.createDataFrame([r + ("d", 3) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    assert sorted((tuple(r) for r in W.round_trip(frame).collect()), key=str) == want(rows)


def test_archives_are_smaller_than_the_copies_and_hold_fresh_headers(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "same " * 400) for i in range(9)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", records_per_file=4, date="2024-01-01T00:00:00Z")

    kinds, records = [], {}
    for name in glob.glob(f"{tmp_path}/w/*.gz"):
        for headers, block in W.parse_records(gzip.open(name)):
            kinds.append(headers["warc-type"])
            records[headers["warc-record-id"]] = headers
            assert len(block) == int(headers["content-length"]) and headers["warc-date"] == "2024-01-01T00:00:00Z"
    assert sorted(kinds) == ["response"] + ["revisit"] * 8 and len(records) == 9
    for headers in records.values():
        if headers["warc-type"] == "revisit":
            original = records[headers["warc-refers-to"]]
            assert original["warc-type"] == "response" and original["x-page-id"] == "8"
            assert headers["warc-refers-to-target-uri"] == original["warc-target-uri"] and headers["warc-refers-to-date"] == original["warc-date"]
    back = W.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert {r["url"] for r in back} == {f"http://a/{i}" for i in range(9)} and {r["payload_bytes"] for r in back} == {2000}


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_pages_and_large_payloads(spark):
    rows = [(1, "http://a", "y" * 1200), (1, "http://b", "y" * 1200), (2, "http://c", "k" * 1500), (2, "http://c", "m" * 1500)] + [(10 + i, "http://big", chr(97 + i) * 8_000_000) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in W.round_trip(frame).collect()), key=str) == want(rows)
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT")
    path = W.shared_path(spark, "warc-test")
    W.write_archives(frame, path)
    name = glob.glob(f"{path.removeprefix('file:').replace('//', '/')}/*.gz")[0]
    assert next(W.parse_records(gzip.open(name)))[0]["warc-date"].startswith(when)


def test_marks_that_collide_keep_every_record(spark, monkeypatch):
    monkeypatch.setattr(W, "MARK_BITS", 8)
    rows = [(i, f"http://a/{i}", f"{i % 60} " * 600) for i in range(150)] + [(None, None, "0 " * 600), (None, None, "n" * 1200), (7, "http://again", "s")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in W.round_trip(frame).collect()), key=str) == want(rows)


def test_files_are_bounded_by_the_size_of_their_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SIZE_CLASSES", ((2000, 50), (20_000, 4), (None, 1)))
    rows = [(i, f"http://a/{i}", chr(97 + i % 26) * (1500 + i) if i % 3 else f"{i} " * 4000) for i in range(60)] + [(90 + i, "http://b", f"{i} " * 30_000) for i in range(3)]
    rows += [(99, "http://b", "0 " * 30_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write_archives(frame, f"file://{tmp_path}/w")
    for name in glob.glob(f"{tmp_path}/w/*.gz"):
        sizes = [len(b) for h, b in W.parse_records(gzip.open(name)) if h["warc-type"] == "response"]
        assert len(sizes) <= (1 if max(sizes, default=0) > 21_000 else 4 if max(sizes, default=0) > 2100 else 50)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in W.read_archives(spark, f"file://{tmp_path}/w").select(names).collect()), key=str) == want(rows)
