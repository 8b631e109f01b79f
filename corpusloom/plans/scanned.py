"""Registered queries of scans in a total order, and of graph contexts for a table of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, snapshot
from .queries import _CHANGES, _GRAPH, _nation_graph, _snapshots, query, table


@query(
    f"""WITH {_CHANGES}, a AS (SELECT path, status, status <> 'deleted' AS skipped FROM ch)
SELECT path, CAST(count(*) OVER w AS BIGINT) AS files_seen, CAST(sum(CAST(NOT skipped AS INT)) OVER w AS BIGINT) AS files_changed, CAST(sum(CAST(skipped AS INT)) OVER w AS BIGINT) AS files_skipped,
  CAST(sum(CAST(NOT skipped AND status = 'deleted' AS INT)) OVER w AS BIGINT) AS files_deleted FROM a WINDOW w AS (ORDER BY path ROWS UNBOUNDED PRECEDING)"""
)
def total_progress(spark, sf_dir):
    """Counters over one run of all files."""
    old, new = _snapshots(spark, sf_dir)
    actions = snapshot.file_actions(snapshot.classify(new, old), old.limit(0))
    return snapshot.progress(actions).select("path", "files_seen", "files_changed", "files_skipped", "files_deleted")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p, row_number() OVER w AS rn FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM o WHERE rn = 1 OR s IS DISTINCT FROM o_orderstatus OR p IS DISTINCT FROM o_orderpriority"""
)
def total_adjacent_repeats(spark, sf_dir):
    """All orders as one sequence."""
    kept = answers.drop_adjacent(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    f"""WITH {_GRAPH},
q AS (SELECT conv_id, turn AS n, CASE WHEN turn = 1 THEN (SELECT min(name) FROM g) ELSE 'src/nation_' || (conv_id * 7 + turn * 11) % 25 || '.ts' END AS target FROM conversations WHERE turn < 3),
c AS (
  SELECT conv_id, n, 'contains' AS relation, path, name, start_line, row_number() OVER (PARTITION BY conv_id, n ORDER BY start_line, name) AS k FROM q JOIN g ON path = target
  UNION ALL
  SELECT conv_id, n, 'matches_symbol', path, name, start_line, row_number() OVER (PARTITION BY conv_id, n ORDER BY path, start_line) FROM q JOIN g ON name = target),
o AS (SELECT *, lag((path, relation, name, start_line)) OVER (PARTITION BY conv_id ORDER BY path, name, n, relation, start_line) AS before FROM c WHERE k <= 24),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path, name, n, relation, start_line) AS place FROM o WHERE before IS DISTINCT FROM (path, relation, name, start_line))
SELECT conv_id, CAST(place AS INTEGER) AS place, relation, path, name, start_line FROM d WHERE place <= 24"""
)
def question_contexts(spark, sf_dir):
    """The symbols around the first three results of every conversation, results being a file or a symbol's name."""
    _, symbols, edges = _nation_graph(spark, sf_dir)
    least = symbols.agg(F.min("name").alias("least"))
    asked = table(spark, sf_dir, "conversations").where("turn < 5").crossJoin(F.broadcast(least))  # one row
    file = F.concat(F.lit("src/nation_"), ((F.col("conv_id") * 7 + F.col("turn") * 11) % 25).cast("string"), F.lit(".ts"))
    results = asked.select(F.col("conv_id").alias("question"), F.when(F.col("turn") == 1, F.col("least")).otherwise(file).alias("path"), F.col("turn").alias("ord"))
    found = answers.contexts_of_results(results, symbols, edges)
    return found.select(F.col("question").alias("conv_id"), "place", "relation", "path", "name", "start_line")
