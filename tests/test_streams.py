"""Throttled progress as a stream, the source of file events, and the page sink."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.page_files import PageFiles, export_pages
from corpusloom.streaming import file_events, watch

EVENTS = "run_id long, ts timestamp, phase string, n long"


def start(stream, folder, name):
    watch.run_to_table(stream, f"file://{folder}/{name}", f"file://{folder}/{name}-checkpoint")


def test_throttle_as_a_stream_equals_the_table(spark, tmp_path):
    rng, base = random.Random(9), dt.datetime(2024, 1, 1)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([5, 30, 90, 200])
        rows.append((rng.choice([1, 1, 2]), base + dt.timedelta(milliseconds=at), rng.choice(["parse", "parse", "complete", None]), i))
    folder = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    last = base + dt.timedelta(days=1)  # moves the watermark past the rows before it
    parts = [rows[:150], rows[150:151], rows[151:], [(1, last, "parse", -1), (2, last, "parse", -2)], [(3, last, "parse", -3)]]
    for i, part in enumerate(parts):  # each part is a run of its own, from the checkpoint
        mixed = rng.sample(part, len(part))
        spark.createDataFrame(mixed, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        start(watch.throttle_stream(stream()), tmp_path, "out")
        if i == 0:
            early = spark.read.parquet(f"file://{tmp_path}/out").count()
    got = sorted(r["n"] for r in spark.read.parquet(f"file://{tmp_path}/out").where("n >= 0").collect())
    want = sorted(r["n"] for r in watch.throttle(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == want and len(got) < len(rows) and early < len(got)


def put(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(content)


def test_file_events_arrive_once(spark, tmp_path):
    root, listings = f"{tmp_path}/ws", f"file://{tmp_path}/listings"
    put(root, "src/a.ts", "1")
    put(root, "src/b.ts", "1")

    def run():
        start(file_events.file_events(spark, f"file://{root}", listings), tmp_path, "events")
        if not os.path.exists(f"{tmp_path}/events"):
            return []
        held = spark.read.schema(file_events.SCHEMA).parquet(f"file://{tmp_path}/events").orderBy("at", "path").collect()
        return [(r["path"], r["kind"], r["size_bytes"]) for r in held]

    assert run() == []  # what is there at the start is no event
    put(root, "src/c.ts", "12")
    put(root, "src/a.ts", "123")
    first = [("src/a.ts", "changed", 3), ("src/c.ts", "created", 2)]
    assert run() == first
    assert run() == first  # nothing new
    os.remove(f"{root}/src/b.ts")
    put(root, "docs/d.md", "")
    assert run() == first + [("docs/d.md", "created", 0), ("src/b.ts", "deleted", 1)]
    assert len(os.listdir(f"{tmp_path}/listings")) <= 2


def test_a_batch_that_is_run_again_gives_the_same_rows(tmp_path):
    root = f"{tmp_path}/ws"
    put(root, "a", "1")
    reader = file_events._Reader({"root": f"file://{root}", "listings": f"file://{tmp_path}/l"})
    begin = reader.initialOffset()
    put(root, "b", "1")
    middle = reader.latestOffset()
    os.remove(f"{root}/b")
    end = file_events._Reader({"root": f"file://{root}", "listings": f"file://{tmp_path}/l"}).latestOffset()  # after a restart
    read = lambda r, a, b: [(x[0], x[1]) for p in r.partitions(a, b) for x in r.read(p)]
    assert read(reader, begin, middle) == read(reader, begin, middle) == [("b", "created")]
    assert read(reader, begin, end) == [("b", "created"), ("b", "deleted")] and read(reader, end, end) == []
    reader.commit(end)
    assert reader.listings.numbers() == [end["listing"]] and reader.initialOffset() == end


def test_events_run_through_filter_and_debounce(spark, tmp_path):
    root = f"{tmp_path}/ws"
    put(root, "src/a.ts", "1")
    listings = f"file://{tmp_path}/listings"
    bursts = lambda: watch.debounce(watch.watched(file_events.file_events(spark, f"file://{root}", listings)), time="at")
    start(bursts(), tmp_path, "bursts")
    put(root, "src/a.ts", "12")
    put(root, "node_modules/x.ts", "12")
    start(bursts(), tmp_path, "bursts")
    raw = file_events._Listings(f"file://{root}", listings)
    for hour in (1, 2):  # a listing an hour later moves the watermark, and the batch after it tells the burst
        put(root, "src/z.ts", "z" * hour)
        late = raw.look()
        late["at"] += hour * 3_600_000_000
        raw.write(raw.numbers()[-1] + 1, late)
        start(bursts(), tmp_path, "bursts")
    assert [r["path"] for r in spark.read.parquet(f"file://{tmp_path}/bursts").collect()][:1] == ["src/a.ts"]


PAGES = "file_name string, markdown string"


def test_each_page_is_a_file_once(spark, tmp_path):
    folder = f"{tmp_path}/pages"
    export_pages(spark.createDataFrame([(f"p{i}.md", f"# {i}\n") for i in range(40)] + [("é.md", "ñ"), ("none.md", None)], PAGES).repartition(5), folder)
    assert len(os.listdir(folder)) == 42 and open(f"{folder}/p7.md").read() == "# 7\n" and open(f"{folder}/é.md", encoding="utf-8").read() == "ñ"
    export_pages(spark.createDataFrame([("p7.md", "new")], PAGES), folder)
    assert open(f"{folder}/p7.md").read() == "new" and len(os.listdir(folder)) == 42


def test_an_attempt_that_is_not_accepted_leaves_nothing(tmp_path):
    writer = PageFiles({"folder": f"file://{tmp_path}/pages"}).writer(type("S", (), {"fieldNames": lambda self: ["file_name", "markdown"]})(), False)
    rows = lambda text: iter([{"file_name": "a.md", "markdown": text}])
    first, second = writer.write(rows("one")), writer.write(rows("two"))  # the same task twice
    assert os.listdir(f"{tmp_path}/pages") == [f".staging-{writer.job}"]
    writer.commit([second])
    assert os.listdir(f"{tmp_path}/pages") == ["a.md"] and open(f"{tmp_path}/pages/a.md").read() == "two" and first.folder != second.folder


def test_a_commit_holds_no_names_and_the_last_row_stays(tmp_path, monkeypatch):
    import pickle

    from corpusloom.sources import page_files

    monkeypatch.setattr(page_files, "FOLDER_PAGES", 7)
    writer = PageFiles({"folder": f"file://{tmp_path}/pages"}).writer(type("S", (), {"fieldNames": lambda self: ["file_name", "markdown"]})(), False)
    rows = lambda n: iter([{"file_name": f"page {i % 50}.md", "markdown": str(i)} for i in range(n)])
    few, many, gone = writer.write(rows(1)), writer.write(rows(120)), writer.write(rows(20))
    assert len(pickle.dumps(many)) == len(pickle.dumps(few)) and gone.folder != many.folder
    writer.commit([few, None, many])
    assert {n: open(f"{tmp_path}/pages/{n}").read() for n in os.listdir(f"{tmp_path}/pages")} == {f"page {i % 50}.md": str(i) for i in range(120)}


def test_a_job_that_fails_leaves_no_page(spark, tmp_path):
    folder = f"{tmp_path}/pages"
    bad = spark.createDataFrame([("a.md", "x"), ("../b.md", "x")], PAGES).coalesce(1)
    with pytest.raises(Exception, match="no file name"):
        export_pages(bad, folder)
    assert os.listdir(folder) == []
    with pytest.raises(Exception):
        export_pages(bad.withColumn("markdown", F.raise_error(F.lit("no")).cast("string")), folder)
    assert os.listdir(folder) == []


def test_a_scan_packs_small_files_and_leaves_settings(spark, tmp_path):
    from corpusloom.sources.files import scan_tree, written_scan
    from corpusloom.sources.page_files import export_pages

    tree, name = tmp_path / "tree", "spark.sql.files.openCostInBytes"
    export_pages(spark.range(200).selectExpr("concat('f', id, '.go') file_name", "concat('package p', id) markdown"), str(tree))
    held = spark.conf.get(name)
    found = written_scan(scan_tree(spark, f"file://{tree}"))
    assert found.count() == 200 and spark.conf.get(name) == held
    assert len(found.inputFiles()) <= 4
