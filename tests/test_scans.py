"""Distributed scans against a walk in Python, and how many tasks share one group."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, graph, scans, snapshot

ROWS = "g string, at long, k string, v long"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice(["x", "x", "y", None]), rng.choice([0, 1, 5])) for i in range(n)]


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_against_a_walk(spark, group, n):
    held = rows(n)
    df = spark.createDataFrame(random.Random(2).sample(held, n), ROWS).repartition(5)
    totals, last, sums, kept = {}, {}, [], []
    for g, at, k, v in held:
        of = g if group else 0
        totals[of] = totals.get(of, 0) + v
        sums.append((at, totals[of]))
        if of not in last or last[of] != k:
            kept.append(at)
        last[of] = k
    found = scans.running_totals(df, ["at"], {"total": F.col("v")}, group)
    assert found.columns == [*df.columns, "total"] and sorted((r["at"], r["total"]) for r in found.collect()) == sums
    left = scans.without_adjacent_repeats(df, ["at"], ["k"], group)
    assert left.columns == df.columns and sorted(r["at"] for r in left.collect()) == kept


def test_one_group_lies_in_many_tasks(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"))
    held = scans.placed(df.withColumn("_group", F.lit(0)), "_group", "id")
    assert held.select("_part").distinct().count() >= 4 and held.groupBy("_part").count().agg(F.max("count")).first()[0] < 10_000
    plan = scans.running_totals(df, ["id"], {"total": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_progress_keeps_extra_columns(spark):
    actions = spark.createDataFrame([("b", "deleted", False, 7), ("a", "new", False, 8), ("c", "unchanged", True, 9)], "path string, status string, skipped boolean, part int")
    got = sorted((r["path"], r["part"], r["files_seen"], r["files_changed"], r["files_skipped"], r["files_deleted"]) for r in snapshot.progress(actions).collect())
    assert got == [("a", 8, 1, 1, 0, 0), ("b", 7, 2, 2, 0, 1), ("c", 9, 3, 2, 1, 1)]


def test_contexts_of_a_table_equal_those_of_each_question(spark):
    kinds = ", ".join(f"{c} {'long' if c.endswith(('line', 'column')) else 'string'}" for c in graph.SYMBOL_COLUMNS)
    rng = random.Random(5)
    held = [(f"f{i % 4}", rng.choice("stuv"), "function", None, None, i, 1, i, 9) for i in range(80)]
    symbols = graph.graph_symbols(spark.createDataFrame(held, kinds))
    edges = graph.contains(spark.createDataFrame(held, kinds))
    results = [(q, rng.choice(["f0", "f1", "f2", "s", "t", "none"]), o) for q in range(5) for o in range(4)]
    table = spark.createDataFrame(results, "question long, path string, ord long")
    own = lambda r: tuple(r[c] for c in ("relation", *graph.SYMBOL_COLUMNS))
    found = answers.contexts_of_results(table, symbols, edges).orderBy("question", "place").collect()
    for q in range(5):
        one = answers.context_of_results(table.where(F.col("question") == q), symbols, edges).collect()
        assert [own(r) for r in found if r["question"] == q] == [own(r) for r in one]
        wanted = []
        for n, path in enumerate([p for a, p, o in results if a == q][: answers.CONTEXT_RESULTS]):
            wanted += [(r["path"], r["name"], n, r["relation"], r["start_line"]) for r in graph.graph_context(symbols, edges, path, answers.CONTEXT_LIMIT).collect()]
        kept = []
        for w in sorted(wanted):
            if not kept or (kept[-1][0], kept[-1][1], kept[-1][3], kept[-1][4]) != (w[0], w[1], w[3], w[4]):
                kept.append(w)
        assert [(r["path"], r["name"], r["relation"], r["start_line"]) for r in one] == [(w[0], w[1], w[3], w[4]) for w in kept[: answers.CONTEXT_LIMIT]]
