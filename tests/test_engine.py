import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, filters, graph, snapshot
from corpusloom.plans.engine import Engine
from corpusloom.sources import files as sources
from corpusloom.streaming import watch


def put(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(content)


@pytest.fixture
def engine(spark, tmp_path):
    root = str(tmp_path / "ws")
    put(root, "src/App.tsx", "import React from 'react';\nimport { helper } from 'lib/helper';\nexport function App() { return <main>Orange Grove Search</main>; }\n")
    put(root, "src/lib/helper.ts", "export const helper = () => 1;\n")
    put(root, "tools/theme.go", "package main\n\nfunc Theme() {}\n")
    put(root, "README.md", "# Orange grove\nSearch notes.\n")
    put(root, "node_modules/p/index.ts", "export const no = 1;\n")
    return Engine(spark, root)


def test_content_is_read_of_kept_files_only(spark, tmp_path):
    root = str(tmp_path / "a tree")
    for path in ("src/a.py", "src/b c.py", "src/50%.py", "src2/d.py"):
        put(root, path, "x = 1\n")
    for path in (".git/objects.py", "node_modules/p/i.ts", "picture.bin"):
        put(root, path, "y" * 4000)
    plain = str(tmp_path / "tree")
    os.rename(root, plain)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # to read a longer file's content is an error
    try:
        found = lambda **k: sorted(r["path"] for r in sources.scan_tree(spark, f"file://{plain}", **k).select("path", "content").collect())
        assert found() == ["src/50%.py", "src/a.py", "src/b c.py", "src2/d.py"]
        assert found(below="src") == ["src/50%.py", "src/a.py", "src/b c.py"]
        assert found(below="src/b c.py") == ["src/b c.py"] and found(below="src/a") == []
        with pytest.raises(Exception, match="(?i)max"):
            found(keep=lambda _: F.lit(True))
        os.rename(plain, root)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    spaced = sources.scan_tree(spark, f"file://{root}").select("path").collect()
    assert sorted(r["path"] for r in spaced) == ["src/50%.py", "src/a.py", "src/b c.py", "src2/d.py"]


def test_files_are_listed_by_tasks_and_all_are_found(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    for i in range(60):
        put(root, f"d{i % 5}/e{i % 3}/f{i}.py", "x")
    put(root, "pkg/__init__.py", "")
    put(root, ".hidden/a.py", "x")
    os.symlink(root, f"{root}/d0/again")  # a link back up ends there
    os.symlink(f"{root}/pkg", f"{root}/linked")
    want = sorted([f"d{i % 5}/e{i % 3}/f{i}.py" for i in range(60)] + ["pkg/__init__.py", "linked/__init__.py"])
    for most in (sources.TASK_ENTRIES, 2):  # 2: folders are handed on, one pass after another
        monkeypatch.setattr(sources, "TASK_ENTRIES", most)
        scan = sources.scan_tree(spark, f"file://{root}")
        assert sorted(r["path"] for r in scan.collect()) == want
        assert not any(f.endswith(".py") for f in scan.inputFiles())  # the plan, and so the driver, holds no file of the tree
    assert sources.delete_files(spark, f"file://{root}/d1") == 12 and sources.listed_files(spark, root)[1] == 50
    assert os.path.exists(f"{root}/.hidden/a.py")


def test_index_run(engine):
    first = engine.index_path()
    assert (first["files_seen"], first["files_changed"], first["files_skipped"], first["run_status"]) == (4, 3, 1, "complete")
    again = engine.index_path()
    assert (again["files_changed"], again["files_skipped"]) == (0, 4)
    put(engine.root, "tools/theme.go", "package main\n\nfunc Other() {}\n")
    os.remove(os.path.join(engine.root, "src/lib/helper.ts"))
    assert engine.check_file_changed("tools/theme.go") == "changed" and engine.check_file_changed("src/lib/helper.ts") == "deleted"
    third = engine.index_path()
    assert (third["files_changed"], third["files_deleted"]) == (2, 1)
    assert [r["name"] for r in engine.get_graph_symbols("tools/theme.go").collect()] == ["Other"]
    assert engine.get_graph_symbols("src/lib/helper.ts").count() == 0
    assert [r["path"] for r in engine.get_tracked_files().collect()] == ["README.md", "src/App.tsx", "tools/theme.go"]
    assert engine.get_index_status().first()["id"] == 3
    assert engine.get_file_metadata("src/lib/helper.ts").first()["status"] == "deleted"
    with pytest.raises(ValueError):
        engine.check_inside("../x")


def test_search_pages_and_answers(engine):
    engine.index_path()
    summary = engine.rebuild_search_index()
    assert summary["documents_indexed"] == 4
    assert engine.search_text("orange grove", 5).first()["path"] in ("README.md", "src/App.tsx")
    found = engine.hybrid_search("grove search", 5).collect()
    assert found and found[0]["start_line"] == 1
    assert {"README.md", "src/App.tsx"} <= {r["path"] for r in engine.project_overview(4).collect()}
    said = engine.ask_local("where is orange grove search", "src/App.tsx")
    assert said.citations and "App.tsx" in said.answer and said.provider == "local-retrieval"
    assert engine.ask_local("list files").answer.startswith("## Indexed Files\nFound 4")
    assert "## Project Overview" in engine.ask_local("what does this project do").answer
    told = engine.ask_local("what is the orange grove search for", generate=lambda prompt: "App.tsx renders the grove search.")
    assert told.provider in ("generator", "local-retrieval")
    assert engine.generate_wiki() == 3 and "# `src/App.tsx`" in engine.get_wiki_content("src/App.tsx") and engine.get_wiki_content("no") is None
    nodes, edges = engine.get_graph_view("src/App.tsx", 20)
    assert {"lib::react", "src/lib/helper.ts"} <= {r["id"] for r in nodes.collect()} and edges.where("label = 'imports'").count() == 3
    assert engine.route("/search", {"query": "grove", "limit": 2})[0] == 200 and engine.route("/save", {})[0] == 404
    engine.clear_search_index()
    assert engine.hybrid_search("grove", 5).count() == 0
    assert engine.set_settings(model_path="m").model_path == "m" and engine.get_settings().model_path == "m"


def test_files_that_are_not_utf8_are_errors_of_their_own(engine):
    with open(os.path.join(engine.root, "src/latin.ts"), "wb") as f:
        f.write("export const café = 1;\n".encode("latin-1"))
    first = engine.index_path()
    assert (first["files_seen"], first["files_changed"], first["files_skipped"], first["errors"], first["run_status"]) == (5, 3, 1, 1, "error")
    assert [(r["path"], r["message"]) for r in engine.get_errors().collect()] == [("src/latin.ts", "src/latin.ts: stream did not contain valid UTF-8")]
    assert engine.get_index_status().first()["status"] == "error" and engine.get_graph_symbols("src/App.tsx").count() > 0
    assert engine.get_file_metadata("src/latin.ts").first()["last_indexed_at"] is None
    assert engine.index_path()["errors"] == 1  # it is tried again
    summary = engine.rebuild_search_index()
    assert summary == {"documents_indexed": 4, "embeddings_indexed": 4, "errors": 1}
    assert [r["path"] for r in engine.get_errors("search").collect()] == ["src/latin.ts"]
    put(engine.root, "src/latin.ts", "export const cafe = 1;\n")
    mended = engine.index_path()
    assert (mended["errors"], mended["files_changed"], mended["run_status"]) == (0, 1, "complete") and engine.get_errors().count() == 0


def test_titles_vectors_and_paths_of_documents(engine):
    engine.rebuild_search_index()
    titles = {r["path"]: r["title"] for r in engine.table("search_documents").collect()}
    assert titles["src/lib/helper.ts"] == "helper.ts" and engine.table("search_chunks").where("title = 'helper.ts:L1-L1'").count() == 1
    told = engine.get_embedding("src/App.tsx").first()
    assert told["dimensions"] == 64 and abs(told["magnitude"] - 1) < 1e-9
    assert engine.search_text("src/lib/helper.ts", 5).first()["path"] == "src/lib/helper.ts"
    assert engine.search_text("tools", 5).count() == 0  # a folder is no word of a title


def test_requests_of_agents(engine):
    engine.index_path()
    assert len(engine.route("/where", {"target": "src/App.tsx"})[1]["context"]) == 5
    assert len(engine.route("/where", {"target": "src/App.tsx", "limit": 2}, "POST")[1]["context"]) == 2
    assert engine.route("/where", {"path": "src/App.tsx"}, "POST")[0] == 400 and engine.route("/search", {"limit": 3}, "POST")[0] == 400
    assert engine.route("/search", {"query": "x", "limit": "3"}, "POST")[0] == 400
    assert engine.route("/index", {"path": "."}, "GET")[0] == 404 and engine.route("/status", {}, "POST")[0] == 404
    assert engine.route("/status", {}, "GET")[1]["status"] == "ready"


def test_unchanged_file_that_the_graph_lacks_is_parsed(engine):
    assert engine.record_file_metadata("tools/theme.go").count() == 1
    run = engine.index_path()
    assert engine.get_graph_symbols("tools/theme.go").count() == 1 and run["files_changed"] == 3


def test_pages_and_log_on_disk(spark, tmp_path):
    pages = spark.createDataFrame([("a.md", "src/a", "# a")], "file_name string, path string, markdown string")
    sources.export_pages(pages, str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "a.md").read_text() == "# a"
    sources.append_log(spark.createDataFrame([("1", "started token=abc")], "at string, message string"), f"file://{tmp_path}/log")
    assert spark.read.text(f"file://{tmp_path}/log").first()[0] == "[1] started [redacted]"


def test_project_root(spark):
    folders = spark.createDataFrame([("/w/app", ["package.json", ".git"]), ("/w/app/dist", ["a.js"]), ("/w/app/src", ["x.ts"]), ("/g", [".git"]), ("/g/out", [])], "folder string, entries array<string>")
    assert sources.resolve_root(folders, "/w/app/dist") == "/w/app" and sources.resolve_root(folders, "/w/app/src") == "/w/app"
    assert sources.resolve_root(folders, "/g/out") == "/g/out" and sources.resolve_root(folders, "/w/app/src", home="/w/app") == "/w/app/src"


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = snapshot.upsert(old, batch, ["id"])
    assert sorted(map(tuple, snapshot.upsert(once, batch, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert snapshot.ensure_column(old, "w", "int", 7).first()["w"] == 7


def test_adjacent_repeats_only(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "n int, k string")
    assert [r["n"] for r in answers.drop_adjacent(rows, ["n"], ["k"]).orderBy("n").collect()] == [1, 3, 4]


def test_grounding():
    cited = [{"path": "src/a/tree.rs", "snippet": "struct Walker holds (pending) entries"}]
    assert answers.grounded("See tree.rs for it", cited) and answers.grounded("The walker has pending work", cited)
    assert not answers.grounded("Nothing here", cited) and not answers.grounded("tree.rs", []) and not answers.grounded("tree.rs\n" * 40, cited)


def test_graph_writes_are_idempotent(spark):
    rows = [("a.ts", "App:Shell", "component", None, None, 3, 16, 4, 2), ("a.ts", "App:Shell", "component", None, None, 3, 16, 4, 2), ("a.ts", "react", "import", None, "react", 1, 1, 1, 9)]
    symbols = spark.createDataFrame(rows, "path string, name string, kind string, parent string, source string, start_line long, start_column long, end_line long, end_column long")
    nodes = graph.graph_symbols(symbols)
    assert sorted(r["id"] for r in nodes.collect())[0] == "a.ts::component::App:Shell::3::16" and nodes.count() == 2 and graph.contains(symbols).count() == 2
    files = spark.createDataFrame([("a.ts",)], "path string")
    assert graph.replace_files(nodes, nodes, files).count() == 2 and graph.clear_files(nodes, files).count() == 0


def test_schema_and_graph_filters(spark):
    cases = {"db/x.sql": True, "a/init.sql": True, "a/b.sql": False, "a/schema.txt": False}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", filters.is_sql_schema("path").alias("ok"))
    assert {r["path"]: r["ok"] for r in rows.collect()} == cases
    assert spark.range(1).select(filters.is_graph_source(F.lit("a.md")), filters.is_graph_source(F.lit("a.rs"))).first()[:] == (False, True)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"src/{i % 3}.ts" if i % 5 else "dist/x.ts", start + dt.timedelta(milliseconds=40 * i * (1 + i % 4))) for i in range(60)]
    rows.append(("src/end.ts", start + dt.timedelta(hours=1)))
    frame = spark.createDataFrame(rows, "path string, ts timestamp")
    source = f"file://{tmp_path}/in"
    frame.repartition(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    watch.run_to_table(watch.debounce(watch.watched(stream)), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    batch = {tuple(r) for r in watch.debounce(watch.watched(frame)).where("path <> 'src/end.ts'").collect()}
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got and got == batch


def test_throttle_is_a_fold(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(milliseconds=ms), "complete" if ms == 200 else "indexing") for ms in (0, 100, 150, 200, 280, 345)]
    frame = spark.createDataFrame(rows, "run_id string, ts timestamp, phase string")
    shown = sorted((r["ts"] - start).total_seconds() * 1000 for r in watch.throttle(frame).collect())
    assert shown == [0, 150, 200, 345]


def test_every_citation_is_ranked(spark):
    rows = [(f"src/{i % 5}.rs", i % 2 or None, (i * 37 % 50) / 50, i) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, start_line long, score double, ord long").withColumn("end_line", F.col("start_line")).repartition(7)
    got = {r["rank"]: r["ord"] for r in answers.number_citations(df, "src/3.rs").collect()}
    priority = lambda r: 100 * (r[0] == "src/3.rs") + 20 + 10 * (r[1] is not None)
    assert got == {n: r[3] for n, r in enumerate(sorted(rows, key=lambda r: (-priority(r), -r[2], r[3])), 1)}
    assert answers.number_citations(df.limit(0)).count() == 0
