"""Every registered query that SQL can express gives the same rows as its SQL."""

import duckdb
import pytest

from corpusloom.plans import answered, derived, indexed, scanned, trees, varied  # noqa: F401
from corpusloom.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Texts and names that SQL and Spark's or Python's own functions take differently.
ODD_TEXTS = ["", None, "\n", "\r\n", "a\r\nb\r", "\r# a\n## b # c", "a\vb\x1cc d e", "# \n# x", "```\n[a](b)\n```"]
ODD_TEXTS += ["\n".join(mark if i == 60 else "line" for i in range(200)) for mark in ("", "\t", "\v", " ", "　def x", "\f def x", "\r", "\x1cfn y", " ")]
ODD_NAMES = [("en", "web"), (None, "web"), ("en", None), (None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents of odd texts, languages and sources, and a connection that sees it."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, *ODD_NAMES[0 if i < len(ODD_TEXTS) else i % 4]) for i, t in enumerate(ODD_TEXTS + ["a b"] * 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_summary", "page_stats"])
def test_odd_texts_give_the_rows_of_sql(spark, odd, name):
    folder, con = odd
    test_same_rows(spark, folder, con, name)
