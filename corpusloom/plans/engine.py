"""The engine: one method per command, over tables in a state folder.

Tables are Parquet, cut into buckets of their path (sources/store.py): a change
writes the buckets it touches, and one commit names the versions of all tables
that it changes, so readers never see a run's files without its graph.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __name__ as NAME
from ..functions.paths import base_name, document_kind
from ..operators import answers, chunks, graph, pages, schemas, search, snapshot, term_index
from ..operators.filters import STATE_DIR, is_searchable
from ..operators.symbols import parse_files
from ..sources import files as sources
from ..sources.store import BUCKETS, Tables

SCHEMAS = {
    "files": "path string, workspace_root string, language string, size_bytes long, modified_at string, content_hash string, last_indexed_at string, status string",
    "index_runs": "id long, started_at string, finished_at string, files_seen long, files_changed long, status string",
    "search_documents": "path string, kind string, title string, content string, updated_at string",
    "search_chunks": "path string, chunk_id string, kind string, title string, content string, start_line long, end_line long, updated_at string",
    "chunk_embeddings": "path string, chunk_id string, vector array<double>",
    "embeddings": "path string, dimensions int, magnitude double, vector array<double>, updated_at string",
    "errors": "source string, path string, message string",
    "graph_files": "path string, language string, updated_at string",
    "graph_symbols": "path string, name string, kind string, parent string, source string, start_line long, start_column long, end_line long, end_column long, id string",
    "graph_contains": "file_path string, symbol_id string",
    "pages": "file_name string, path string, markdown string",
}
#: The column by whose hash a table is cut into buckets.
KEYS = {n: "path" for n in ("files", "search_documents", "search_chunks", "chunk_embeddings", "embeddings", "graph_files", "graph_symbols", "pages")} | {"graph_contains": "file_path"}
SEARCH_TABLES = ("search_documents", "search_chunks", "chunk_embeddings", "embeddings")


@dataclass
class Settings:
    provider: str = "local"
    cloud_enabled: bool = False
    model_path: str | None = None
    embedding_model_path: str | None = None
    generator_path: str | None = None


class Engine:
    def __init__(self, spark: SparkSession, root: str, state: str | None = None, buckets: int = BUCKETS):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.state = state or os.path.join(self.root, STATE_DIR)
        os.makedirs(self.state, exist_ok=True)
        self.store = Tables(spark, f"file://{self.state}/tables", SCHEMAS, KEYS, buckets)

    # --- tables

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def write(self, name: str, df: DataFrame) -> None:
        self.store.commit(whole={name: df})

    def _source(self, path: str | None = None, keep=None) -> DataFrame:
        whole = not path or path in (".", self.root)
        below = None if whole else os.path.relpath(os.path.join(self.root, path), self.root)
        return sources.scan_tree(self.spark, f"file://{self.root}", *([keep] if keep else []), below=below)

    def _errors(self, source: str, bad: DataFrame) -> DataFrame:
        """The table of errors, those of a source (index or search) replaced by those of its last run."""
        others = self.table("errors").where(F.col("source") != source)
        return others.unionByName(bad.select(F.lit(source).alias("source"), "path", F.col("error").alias("message")))

    def get_errors(self, source: str = "index") -> DataFrame:
        """path, message of each file that the last run could not read."""
        return self.table("errors").where(F.col("source") == source).select("path", "message")

    def check_inside(self, path: str) -> str:
        full = os.path.realpath(os.path.join(self.root, path))
        if full != self.root and not full.startswith(self.root + os.sep):
            raise ValueError(f"{path} is outside the workspace")
        return os.path.relpath(full, self.root)

    # --- metadata and indexing

    def get_file_metadata(self, path: str) -> DataFrame:
        return self.table("files").where((F.col("path") == path) & (F.col("workspace_root") == self.root)).limit(1)

    def check_file_changed(self, path: str) -> str:
        rel = self.check_inside(path)
        scanned = snapshot.describe_files(self._source(rel, lambda _: F.lit(True)), self.root)
        rows = snapshot.classify(scanned.where(F.col("path") == rel), self.table("files").where(F.col("path") == rel)).head(1)
        return rows[0]["status"] if rows else "error"

    def record_file_metadata(self, path: str) -> DataFrame:
        """Stores the files' scanned state with its status, without indexing them."""
        scanned = snapshot.describe_files(self._source(self.check_inside(path), lambda _: F.lit(True)), self.root)
        old = self.table("files")
        status = snapshot.classify(scanned, old).select("path", "status")
        kept = old.select("path", "last_indexed_at")
        batch = scanned.join(status, "path").join(kept, "path", "left")
        self.store.commit(merged={"files": (batch, scanned.select("path"))})
        return self.table("files").join(scanned.select("path"), "path", "left_semi")

    def index_path(self, path: str = ".", now: str | None = None) -> dict:
        """Discovers, classifies, parses what is new or changed, updates files and graph; returns the run's summary.

        The tree is scanned once, and files, graph, errors and the run's end are one commit: a failure before it leaves
        all tables as they were.  A file to be parsed that is not UTF-8 is an error of its own (get_errors): the rest is
        indexed, the file stays unindexed, and the run ends with status error.
        """
        now = now or str(int(time.time() * 1000))
        runs = snapshot.begin_run(self.table("index_runs"), now)
        self.write("index_runs", runs)
        run_id = self.table("index_runs").agg(F.max("id")).first()[0]
        raw = sources.written_scan(self._source(path))
        source = sources.decode(raw)
        scanned = snapshot.describe_files(raw, self.root)
        old = self.table("files")
        rel = None if path in (".", self.root) else self.check_inside(path)
        known = snapshot.tracked_files(old, self.root, rel)
        scope = old.join(known, "path", "left_semi")
        changes = snapshot.classify(scanned, scope)
        actions = snapshot.file_actions(changes, self.table("graph_files"))
        actions = actions.join(source.select("path", "error"), "path", "left").withColumn("error", F.when(F.col("parse"), F.col("error")))
        actions = sources.written(actions, "actions")
        bad = actions.where("error is not null")
        todo = actions.where("parse and error is null").select("path")
        symbols = parse_files(source.join(todo, "path", "left_semi").select("path", "content"))
        touched = todo.unionByName(actions.where("status = 'deleted'").select("path"))
        new_symbols = sources.written(graph.graph_symbols(symbols), "symbols")
        new_files = scanned.join(todo, "path", "left_semi").select("path", "language", F.lit(now).alias("updated_at"))
        new_edges = new_symbols.select(F.col("path").alias("file_path"), F.col("id").alias("symbol_id"))
        live = scanned.withColumn("last_indexed_at", F.lit(None).cast("string")).withColumn("status", F.lit("unchanged"))
        moved = actions.where("not (skipped and status = 'unchanged')")
        indexed = moved.where("error is null").select("path")
        merged = snapshot.mark_indexed(snapshot.upsert(old, live.join(moved, "path", "left_semi"), ["path"]), indexed, now)
        merged = snapshot.mark_deleted(merged, actions.where("status = 'deleted'"))
        changed = moved.select("path").unionByName(touched).distinct()
        summary = snapshot.run_summary(actions).first().asDict()
        done = snapshot.finish_run(self.table("index_runs"), run_id, str(int(time.time() * 1000)), summary["files_seen"], summary["files_changed"], summary["run_status"])
        self.store.commit(
            whole={"index_runs": done, "errors": self._errors("index", bad)},
            merged={
                "graph_symbols": (new_symbols, touched),
                "graph_contains": (new_edges, touched.withColumnRenamed("path", "file_path")),
                "graph_files": (new_files, touched),
                "files": (merged.join(changed, "path", "left_semi"), changed),
            },
        )
        return {"run_id": run_id, **summary}

    index_file = index_path

    def index_file_to_graph(self, path: str) -> int:
        """Parses a file again whatever its state; returns how many symbols the graph has of it."""
        rel = self.check_inside(path)
        source = sources.decode(self._source(rel).where(F.col("path") == rel))
        symbols = parse_files(source.select("path", "content"))
        one = self.spark.createDataFrame([(rel,)], "path string")
        self.store.commit(merged={"graph_symbols": (graph.graph_symbols(symbols), one), "graph_contains": (graph.contains(symbols), one.withColumnRenamed("path", "file_path"))})
        return self.table("graph_contains").where(F.col("file_path") == rel).count()

    def get_index_status(self) -> DataFrame:
        return snapshot.latest_run(self.table("index_runs"))

    def get_tracked_files(self, prefix: str | None = None) -> DataFrame:
        return snapshot.tracked_files(self.table("files"), self.root, prefix)

    # --- graph

    def parse_source_file(self, path: str) -> DataFrame:
        rel = self.check_inside(path)
        return parse_files(sources.decode(self._source(rel, lambda _: F.lit(True)).where(F.col("path") == rel)).select("path", "content"))

    def get_graph_symbols(self, path: str) -> DataFrame:
        return graph.symbols_of_file(self.table("graph_symbols"), self.table("graph_contains"), path)

    def get_graph_context(self, target: str, limit: int = 24) -> DataFrame:
        return graph.graph_context(self.table("graph_symbols"), self.table("graph_contains"), target, limit)

    def get_graph_view(self, path: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        return graph.graph_view(self.table("graph_symbols"), self.table("graph_contains"), self.table("graph_files"), path, limit)

    # --- search

    def _searched(self, source: DataFrame, now: str) -> dict[str, tuple[DataFrame, DataFrame]]:
        """The merges that put decoded files (path, content; written) into the search tables in place of what these hold of them."""
        documents = source.select("path", document_kind("path").alias("kind"), base_name("path").alias("title"), "content", F.lit(now).alias("updated_at"))
        model = self.get_settings().embedding_model_path
        found = sources.written(chunks.chunk_documents(documents.select("path", "title", "content")).withColumn("updated_at", F.lit(now)), "chunks")
        batches = (documents, found, search.embed_chunks(found, model), search.embed_documents(documents, model))
        return {name: (batch, documents.select("path")) for name, batch in zip(SEARCH_TABLES, batches)}

    def rebuild_search_index(self, path: str = ".", now: str | None = None, scanned=None) -> dict:
        """Indexes what can be searched below a path; returns documents_indexed, embeddings_indexed and errors.

        Documents elsewhere stay; the term index is made anew of all chunks.  A file that is not UTF-8 is an error of its
        own (get_errors("search")); the rest is indexed.  scanned is called when the tree has been read.
        """
        now = now or str(int(time.time() * 1000))
        source = sources.written_scan(sources.decode(self._source(path, is_searchable)))
        if scanned:
            scanned()
        read = source.where("error is null")
        self.store.commit(whole={"errors": self._errors("search", source.where("error is not null"))}, merged=self._searched(read, now))
        self.rebuild_term_index()
        n = read.count()
        return {"documents_indexed": n, "embeddings_indexed": n, "errors": self.get_errors("search").count()}

    def rebuild_term_index(self) -> None:
        """Writes the term index of all chunks and names it in one commit."""
        path = self.store.new_folder("term_index")
        term_index.write_index(self.table("search_chunks"), path)
        self.store.commit(folders={"term_index": path})

    def index_document(self, path: str, now: str | None = None) -> dict:
        """Indexes one file for search in one commit, which writes its buckets only; the term index follows at its next rebuild."""
        rel = self.check_inside(path)
        self.record_file_metadata(path)
        read = sources.written(sources.decode(self._source(rel, lambda _: F.lit(True)).where(F.col("path") == rel)), "scan")
        bad = read.where("error is not null").head(1)
        if bad or not read.head(1):
            raise ValueError(bad[0]["error"] if bad else f"{rel}: no such file")
        self.store.commit(merged=self._searched(read, now or str(int(time.time() * 1000))))
        return self.get_embedding(rel).first().asDict()

    def get_embedding(self, path: str) -> DataFrame:
        """path, dimensions, magnitude of a document's vector."""
        return self.table("embeddings").where(F.col("path") == path).select("path", "dimensions", "magnitude")

    def clear_search_index(self) -> None:
        self.store.commit(whole={name: self.spark.createDataFrame([], SCHEMAS[name]) for name in SEARCH_TABLES}, folders={"term_index": None})

    def search_text(self, query: str, limit: int = 10) -> DataFrame:
        """Terms and quoted phrases over the term index."""
        rows, path = self.table("search_chunks"), self.store.folder_of("term_index")
        return term_index.text_results(rows, path, query, limit) if path else search.no_results(rows)

    def hybrid_search(self, query: str, limit: int = 10) -> DataFrame:
        return search.hybrid_search(self.table("search_chunks"), self.table("chunk_embeddings"), query, limit, model_path=self.get_settings().embedding_model_path)

    def project_overview(self, limit: int = 10) -> DataFrame:
        return search.project_overview(self.table("search_chunks"), limit)

    def ask_local(self, query: str, active_path: str | None = None, generate=None) -> answers.Answer:
        return answers.ask(self.table("search_chunks"), self.table("chunk_embeddings"), self.table("search_documents"), self.table("graph_symbols"), self.table("graph_contains"), query, active_path=active_path, generate=generate, model_path=self.get_settings().embedding_model_path)

    # --- pages and schemas

    def generate_wiki(self) -> int:
        live = self.table("graph_symbols").join(self.get_tracked_files(), "path", "left_semi")
        self.write("pages", pages.render_pages(live))
        return self.table("pages").count()

    def get_wiki_content(self, path: str) -> str | None:
        rows = self.table("pages").where(F.col("path") == path).head(1)
        return rows[0]["markdown"] if rows else None

    def detect_database_structure(self) -> tuple[str | None, DataFrame | None]:
        files = sources.scan_tree(self.spark, f"file://{self.root}", lambda _: F.lit(True))
        return schemas.detect_schema(sources.decode(files).where("error is null").select("path", "content"))

    def reset(self) -> None:
        """Forgets all that is derived from the workspace; settings stay."""
        self.store.commit(whole={name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}, folders={"term_index": None})

    # --- settings

    def get_settings(self) -> Settings:
        path = os.path.join(self.state, "settings.json")
        if not os.path.exists(path):
            return Settings()
        with open(path) as f:
            held = json.load(f)
        return Settings(**{k: v for k, v in held.items() if k in Settings.__dataclass_fields__})

    def set_settings(self, **changes) -> Settings:
        new = Settings(**{**asdict(self.get_settings()), **changes})
        with open(os.path.join(self.state, "settings.json"), "w") as f:
            json.dump(asdict(new), f)
        return new

    # --- requests

    def route(self, path: str, body: dict, method: str | None = None) -> tuple[int, dict]:
        """(status, JSON body) of an agent request: GET /status, POST /search, /find, /explain, /where, /trace, /impact, /index."""
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  limits came first
        if method not in (None, "GET" if path == "/status" else "POST"):
            return 404, {"error": "not found"}
        needed = {"/search": "query", "/find": "query", "/explain": "query", "/where": "target", "/trace": "target", "/impact": "target", "/index": "path"}.get(path)
        if needed and not isinstance(body.get(needed), str):
            return 400, {"error": f"missing field `{needed}`"}
        limit = body.get("limit")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
            return 400, {"error": "limit must be a whole number"}
        if path == "/status":
            return 200, {"status": "ready", "localOnly": True, "name": NAME, "root": self.root, "run": rows(self.get_index_status())}
        if path == "/search":
            return 200, {"results": rows(self.hybrid_search(body["query"], 10 if limit is None else limit))}
        if path == "/find":
            return 200, {"results": rows(self.search_text(body["query"], 10 if limit is None else limit))}
        if path == "/explain":
            return 200, asdict(self.ask_local(body["query"], body.get("activePath")))
        if path in ("/where", "/trace", "/impact"):
            return 200, {"context": rows(self.get_graph_context(body["target"], 24 if limit is None else limit))}
        if path == "/index":
            return 200, self.index_path(body["path"])
        return 404, {"error": "not found"}
