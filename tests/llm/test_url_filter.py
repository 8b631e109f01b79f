import datetime as dt
import random
import re

from corpusloom.llm import url_filter as U

DAY = dt.date(2024, 1, 1)


def host_path(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)[^/?#]*([^?#]*)", url or "")
    host = m.group(1).lower().rstrip(".") if m else ""
    return (host, [s for s in m.group(2).split("/") if s]) if host else (None, [])


def brute(captures, entries):
    days = {}
    for kind, pattern, action, since in entries:
        if None not in (kind, pattern, action, since):
            days.setdefault((kind, pattern), {}).setdefault(since, []).append(action)
    out = []
    for page, url, at in captures:
        host, segments = host_path(url)
        keys = []
        if host:
            labels = host.split(".")
            keys = [("prefix", host + "/" + "/".join(segments[:i])) for i in range(len(segments), 0, -1)]
            keys += [("host", host)] + [("domain", ".".join(labels[i:])) for i in range(len(labels))]
        found = ("none", None, None)
        for key in keys:
            known = {d: max(a) for d, a in days.get(key, {}).items() if at is not None and d <= at}
            if known and known[max(known)] != "remove":
                found = (known[max(known)], *key)
                break
        out.append((page, *found))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "x.org", "[::1]"]
    paths = ["", "/", "/en", "/en/1", "/en/1/?q=/z", "/de#x"]
    captures = [(i, f"HTTP{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts).upper() if i % 5 == 0 else rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(paths)}", DAY + dt.timedelta(rng.randrange(30))) for i in range(400)]
    captures += [(500, None, DAY), (501, "no url", DAY), (502, "http://x.org/en", None), (503, "http:///en", DAY), (None, "http://x.org/", DAY), (7, captures[7][1], captures[7][2]), (504, "http://x.org/" + "s/" * 2000, DAY)]
    entries = [(kind, pattern, rng.choice(["block", "allow", "remove"]), DAY + dt.timedelta(rng.randrange(30))) for kind, pattern in [("host", h) for h in hosts] + [("domain", "com"), ("domain", "example.com"), ("prefix", "example.com/en"), ("prefix", "x.org/en/1")] for _ in range(4)]
    entries += [(None, "x", "block", DAY), ("host", "x.org", None, DAY), entries[0]]
    frame = spark.createDataFrame([c + ("k",) for c in captures], "page_id long, url string, fetched date, kind string")
    listed = spark.createDataFrame(entries, "kind string, pattern string, action string, since date")
    got = sorted((tuple(r) for r in U.evaluate(frame, listed).select("page_id", "action", "matched_kind", "matched").collect()), key=str)
    assert got == brute(captures, entries)


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, fetched date")
    listed = spark.createDataFrame([], "kind string, pattern string, action string, since date")
    assert U.evaluate(frame, listed).count() == 0
    one = spark.createDataFrame([(1, "http://x.org", DAY)], "page_id long, url string, fetched date")
    assert [r["action"] for r in U.evaluate(one, listed).collect()] == ["none"]


def test_without_broadcast(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted(map(str, U.page_report(pages).collect()))
    monkeypatch.setattr(U, "BROADCAST_INTERVALS", 0)
    assert sorted(map(str, U.page_report(pages).collect())) == want
