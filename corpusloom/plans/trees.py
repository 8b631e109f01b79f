"""Registered queries of the engine over trees of files that are written from the tables.

The trees lie in the folder that driver and executors share; the engine works on
paths, so that folder must be mounted (a file: URI).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import delete_files
from ..sources.page_files import export_pages
from ..sources.tables import work_path
from .derived import dealt_parts
from .engine import Engine
from .indexed import PHRASES, PHRASES_SQL
from .queries import FILES, query, table


def _root(spark) -> str:
    return work_path(spark, "tree").removeprefix("file://")


def _sources(spark, sf_dir, again: bool):
    """file_name, markdown: a source file a part; again: as a third of them were changed and a fifth came."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("p"), k.cast("string"), F.lit(".go"))
    old, new = F.concat(F.lit("package p\n\nfunc A"), k, F.lit("() {}\n")), F.concat(F.lit("package p\n\nfunc B"), k, F.lit("() {}\nfunc C"), k, F.lit("() {}\n"))
    rows = dealt_parts(spark, sf_dir)
    if again:
        rows = rows.where((k % 3 == 0) | (k % 5 == 0))
        return rows.select(name.alias("file_name"), F.when(k % 3 == 0, new).otherwise(old).alias("markdown"))
    return rows.where(k % 5 != 0).select(name.alias("file_name"), old.alias("markdown"))


@query(
    """WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey || '.go' AS path, 'package p' || chr(10) || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'func B' || p_partkey || '() {}' || chr(10) || 'func C' || p_partkey || '() {}' ELSE 'func A' || p_partkey || '() {}' END || chr(10) AS content FROM part),
n AS (SELECT *, k % 3 = 0 OR k % 5 = 0 AS moved FROM p)
SELECT path, 'go' AS language, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS content_hash, 'unchanged' AS status, CASE WHEN moved THEN '2' ELSE '1' END AS last_indexed_at,
  CASE WHEN k % 3 = 0 THEN 'B' || k || ':3,C' || k || ':4' ELSE 'A' || k || ':3' END AS symbols,
  (SELECT count(*) FROM n) AS files_seen, (SELECT count(*) FROM n WHERE moved) AS files_changed, (SELECT count(*) FROM n WHERE NOT moved) AS files_skipped, 'complete' AS run_status, CAST(2 AS BIGINT) AS run_id FROM n"""
)
def tree_index(spark, sf_dir):
    """Files and their symbols after a tree was indexed, changed and indexed again, with the second run's counts."""
    root = _root(spark)
    export_pages(_sources(spark, sf_dir, False), root)
    engine = Engine(spark, root)
    engine.index_path(now="1")
    export_pages(_sources(spark, sf_dir, True), root)
    run = engine.index_path(now="2")
    delete_files(spark, root)
    symbols = engine.table("graph_symbols").join(engine.table("graph_contains"), F.col("id") == F.col("symbol_id"))
    listed = symbols.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(":"), F.col("start_line").cast("string")))), ",").alias("symbols"))
    told = [F.lit(run[c]).cast("long").alias(c) for c in ("files_seen", "files_changed", "files_skipped")]
    rows = engine.table("files").join(engine.table("graph_files").select("path"), "path").join(listed, "path")
    return rows.select("path", "language", "size_bytes", "content_hash", "status", "last_indexed_at", "symbols", *told, F.lit(run["run_status"]).alias("run_status"), F.lit(run["run_id"]).cast("long").alias("run_id"))


@query(PHRASES_SQL.replace(FILES, "files AS (SELECT doc_id, doc_id || '.md' AS path, text AS content FROM documents)"))
def tree_search(spark, sf_dir):
    """Phrases and a word through the engine's index of a tree of documents."""
    root = _root(spark)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.col("text").alias("markdown"))
    export_pages(docs, root)
    engine = Engine(spark, root)
    engine.rebuild_search_index(now="1", scanned=lambda: delete_files(spark, root))  # the tree is not kept beside its copies
    return engine.search_text(PHRASES, 25).select("path", "chunk_id", F.round("score", 6).alias("score"))
