"""Queries of the training-data operators against their SQL on the smallest tables."""

import duckdb
import pytest

from corpusloom import llm

TABLES = "documents embeddings pages benchmark conversations".split()
ORACLE = llm.oracle_sql()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = llm.queries()[name](spark, sf_dir)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(names, want.fetchall())


def test_one_query_for_each_operator():
    names = sorted(llm.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
