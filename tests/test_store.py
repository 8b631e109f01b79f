"""Buckets and commits: what a change writes, and what readers see when it fails."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.engine import Engine
from corpusloom.sources import store
from corpusloom.sources.store import Conflict, Tables

SCHEMAS = {"a": "path string, v long", "b": "file_path string, w string", "c": "id long"}


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/state", SCHEMAS, {"a": "path", "b": "file_path"}, buckets=8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def files_of(tables, name):
    root = f"{tables.folder.removeprefix('file://')}/{name}"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def frame(spark, name, values):
    return spark.createDataFrame(values, SCHEMAS[name])


def test_a_change_of_one_key_writes_one_bucket(spark, tables):
    tables.commit(whole={"a": frame(spark, "a", [(f"p{i}", i) for i in range(100)])})
    before = files_of(tables, "a")
    tables.commit(merged={"a": (frame(spark, "a", [("p7", -7)]), frame(spark, "a", [("p7", 0)]))})
    after = files_of(tables, "a")
    assert {f: t for f, t in after.items() if f in before} == before  # nothing was written over
    new = set(after) - set(before)
    assert new and len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1
    assert rows(tables.read("a")) == sorted([(f"p{i}", i) for i in range(100) if i != 7] + [("p7", -7)])


def test_random_changes_equal_a_rebuild(spark, tables):
    rng, held = random.Random(3), {}
    for _ in range(6):
        gone = rng.sample(range(40), 5)
        batch = [(f"p{k}", rng.randrange(1000)) for k in gone if rng.random() < 0.6]
        for k in gone:
            held.pop(f"p{k}", None)
        held |= dict(batch)
        tables.commit(merged={"a": (frame(spark, "a", batch), frame(spark, "a", [(f"p{k}", 0) for k in gone]))})
        assert rows(tables.read("a")) == sorted(held.items())


def test_a_failure_between_tables_leaves_all_as_they_were(spark, tables):
    tables.commit(whole={"a": frame(spark, "a", [("x", 1)]), "b": frame(spark, "b", [("x", "one")])})
    number = tables.manifest()[0]
    broken = frame(spark, "b", [("x", "two")]).withColumn("w", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        tables.commit(merged={"a": (frame(spark, "a", [("x", 2)]), frame(spark, "a", [("x", 0)])), "b": (broken, frame(spark, "b", [("x", "")]))})
    assert tables.manifest()[0] == number and rows(tables.read("a")) == [("x", 1)] and rows(tables.read("b")) == [("x", "one")]
    assert tables.remove_orphans() >= 1 and rows(tables.read("a")) == [("x", 1)]


def test_the_second_of_two_writers_is_told(spark, tables):
    tables.commit(whole={"c": frame(spark, "c", [(1,)])})
    number, manifest = tables.manifest()
    tables.commit(whole={"c": frame(spark, "c", [(2,)])})
    with pytest.raises(Conflict):
        tables._publish(number + 1, manifest)
    assert rows(tables.read("c")) == [(2,)]


def test_old_versions_go(spark, tables):
    for i in range(store.KEPT + 3):
        tables.commit(whole={"c": frame(spark, "c", [(i,)])})
    assert len(tables._commits()) == store.KEPT and len(tables._names("c")) == store.KEPT
    tables.commit(whole={"c": frame(spark, "c", [])})
    assert rows(tables.read("c")) == []


def test_folders_are_named_by_commits(spark, tables):
    path = tables.new_folder("index")
    spark.range(3).write.parquet(path)
    assert tables.folder_of("index") is None
    tables.commit(folders={"index": path})
    assert tables.folder_of("index") == path
    tables.commit(folders={"index": None})
    assert tables.folder_of("index") is None


def put(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(content)


def test_engine_changes_touch_their_buckets_and_equal_a_rebuild(spark, tmp_path):
    root = str(tmp_path / "ws")
    for i in range(12):
        put(root, f"src/m{i}.ts", f"export function f{i}() {{ return {i}; }}\n")
    engine = Engine(spark, root, buckets=16)
    engine.index_path()
    before = {n: files_of(engine.store, n) for n in ("graph_symbols", "graph_contains", "graph_files", "files")}
    put(root, "src/m3.ts", "export function other() {}\nexport function more() {}\n")
    os.remove(os.path.join(root, "src/m5.ts"))
    engine.index_path()
    for name, held in before.items():
        after = files_of(engine.store, name)
        assert {f: t for f, t in after.items() if f in held}.items() <= held.items()
        written = {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(held)}
        assert len(written) <= 2  # the buckets of two paths
    fresh = Engine(spark, root, state=str(tmp_path / "fresh"))
    fresh.index_path()
    for name in ("graph_symbols", "graph_contains"):
        assert rows(engine.table(name)) == rows(fresh.table(name))
    engine.rebuild_search_index()
    put(root, "src/m4.ts", "// grove of oranges\n")
    assert engine.index_document("src/m4.ts")["dimensions"] == 64
    assert engine.table("search_documents").count() == 11 and engine.table("search_chunks").where("path = 'src/m4.ts'").first()["content"] == "// grove of oranges"
    assert engine.hybrid_search("grove oranges", 3).first()["path"] == "src/m4.ts"
    assert engine.search_text('"grove of oranges"', 3).count() == 0
    engine.rebuild_term_index()
    assert [r["path"] for r in engine.search_text('"grove of oranges"', 3).collect()] == ["src/m4.ts"]


def test_engine_run_that_fails_leaves_files_and_graph(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ws")
    put(root, "src/a.ts", "export function a() {}\n")
    engine = Engine(spark, root, buckets=4)
    engine.index_path()
    held = {n: rows(engine.table(n)) for n in ("files", "graph_symbols", "graph_contains", "graph_files")}
    put(root, "src/a.ts", "export function b() {}\n")
    write = engine.store._write

    def failing(name, df):
        if name == "graph_files":
            raise OSError("disk full")
        return write(name, df)

    monkeypatch.setattr(engine.store, "_write", failing)
    with pytest.raises(OSError):
        engine.index_path()
    assert {n: rows(engine.table(n)) for n in held} == held
    monkeypatch.setattr(engine.store, "_write", write)
    assert engine.index_path()["files_changed"] == 1 and {r["name"] for r in engine.table("graph_symbols").collect()} == {"b"}
