"""Positional postings, phrases and block-max search against plain scans."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search, term_index

CHUNK = "path string, chunk_id string, kind string, title string, content string, start_line long, end_line long"


def chunk_rows(spark, contents):
    rows = [(f"d/{i % 30}.md", f"chunk-{i:04d}", "wiki", f"{i % 30}.md:L1-L{i}", c, 1, i) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, CHUNK).repartition(3)


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    held = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.choice([3, 20, 90]))) for _ in range(300)]
    return held + ["", "alpha beta alpha beta gamma", "Alpha, BETA! alpha-gamma", "x" * 50 + " tail", "head " + "y" * 60 + " tail", "head tail"]


@pytest.fixture(scope="module")
def index(spark, contents, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    rows = chunk_rows(spark, contents).cache()
    block, term_index.BLOCK_CHUNKS = term_index.BLOCK_CHUNKS, 16
    term_index.write_index(rows, path, shards=8)
    term_index.BLOCK_CHUNKS = block
    return rows, path


def rounded(df):
    return [(r["path"], r["chunk_id"], round(r["score"], 8)) for r in df.collect()]


@pytest.mark.parametrize("query,limit", [("w0 w30", 10), ("w39", 5), ("w1 w2 w3 w17 w38", 25), ("d/3.md", 20), ("d/3.md w5", 7), ("alpha", 10), ("absent", 10), ("w0", 1000), ("", 5)])
def test_same_rows_as_the_scan_of_all_postings(spark, index, query, limit, monkeypatch):
    rows, path = index
    want = rounded(search.bm25_search(rows, search.postings(rows), search.field_stats(rows), query, limit))
    assert rounded(term_index.search(spark, path, query, limit)) == want
    monkeypatch.setattr(term_index, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(term_index, "BROADCAST_BLOCKS", 0)
    assert rounded(term_index.search(spark, path, query, limit)) == want


def phrase_places(content, phrase):
    import re

    words, sought = ([w for w in re.split(r"[^\w]+|_", t.lower()) if w] for t in (content, phrase))
    return sum(words[i : i + len(sought)] == sought for i in range(len(words) - len(sought) + 1)) if sought else 0


@pytest.mark.parametrize("phrase", ["w0 w0", "w0 w1 w0", "alpha beta", "beta alpha beta", "Alpha-gamma", "w3", "gamma w0", "head tail"])
def test_phrases(spark, index, contents, phrase):
    rows, path = index
    found = {r["chunk_id"] for r in term_index.search(spark, path, f'"{phrase}"', 10_000).collect()}
    assert found == {f"chunk-{i:04d}" for i, c in enumerate(contents) if phrase_places(c, phrase)}
    wanted = term_index._wanted(spark, [c for c in term_index.clauses(spark, f'"{phrase}"') if "content" in c.fields])
    counts = {r["chunk_id"]: r["tf"] for r in term_index.phrase_matches(term_index.positional_postings(rows), wanted).where("field = 'content'").collect()}
    assert counts == {f"chunk-{i:04d}": n for i, c in enumerate(contents) if (n := phrase_places(c, phrase))}


def test_a_word_too_long_for_the_index_keeps_its_place(spark, index):
    rows, path = index
    ids = lambda q: sorted(r["chunk_id"] for r in term_index.search(spark, path, q, 100).collect())
    assert ids('"head tail"') == ["chunk-0305"] and ids('"head ' + "z" * 60 + ' tail"') == ["chunk-0304"]


def test_query_parts(spark):
    shape = lambda q: [(c.terms, c.fields) for c in term_index.clauses(spark, q)]
    assert shape('"a b" c') == [([(0, "c")], term_index.FIELDS), ([(0, "a"), (1, "b")], term_index.FIELDS), ([(0, "a b")], ("path",)), ([(0, "c")], ("path",))]
    unbalanced = shape('"a b')
    assert ([(0, "a")], term_index.FIELDS) in unbalanced and ([(0, "b")], term_index.FIELDS) in unbalanced and all(len(t) == 1 for t, _ in unbalanced)
    assert shape('""') == [] and shape("!?") == [([(0, "!?")], ("path",))]


def test_a_search_reads_the_folders_of_its_terms_only(spark, contents, tmp_path):
    rows = chunk_rows(spark, contents)
    path = f"{tmp_path}/index"
    term_index.write_index(rows, f"file://{path}", shards=16)
    want = rounded(term_index.search(spark, f"file://{path}", "w7", 10))
    assert want
    shards = {r[0] for r in spark.createDataFrame([("w7",)], "t string").select(term_index.shard_of("t", 16)).collect()}
    broken = 0
    for file in glob.glob(f"{path}/postings/shard=*/*.parquet") + glob.glob(f"{path}/blocks/shard=*/*.parquet"):
        if int(file.split("shard=")[1].split("/")[0]) not in shards:
            with open(file, "wb") as f:
                f.write(b"no parquet")
            broken += 1
    spark.catalog.clearCache()
    assert broken >= 15 and rounded(term_index.search(spark, f"file://{path}", "w7", 10)) == want
    with pytest.raises(Exception):
        spark.read.parquet(f"file://{path}/postings").agg(F.sum("tf")).collect()


def test_no_chunks(spark, tmp_path):
    term_index.write_index(spark.createDataFrame([], CHUNK), f"file://{tmp_path}/none")
    assert term_index.search(spark, f"file://{tmp_path}/none", "w1", 5).count() == 0


def test_phrases_of_a_table_write_no_index(spark, sf_dir, monkeypatch):
    from corpusloom.plans import indexed

    monkeypatch.setattr(indexed, "written", lambda *_: 1 / 0)
    assert "clause" not in indexed.phrase_matches(spark, sf_dir).columns


def test_a_term_has_one_row_in_a_block(spark, index):
    rows, path = index
    lists = spark.read.parquet(f"{path}/postings")
    assert lists.groupBy("term", "field", "block").count().where("count > 1").count() == 0
    want = search.postings(rows).groupBy("term", "field").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    got = lists.where("field <> 'path'").groupBy("term", "field").agg(F.sum("n").alias("n"), F.sum("tf").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert lists.where("field = 'path'").agg(F.sum("n")).first()[0] == rows.count()


def test_words_are_those_of_the_query_s_terms(spark, monkeypatch):
    rng = random.Random(3)
    points = [*range(32, 0x3000), *range(0xA640, 0xAC00), *range(0x10000, 0x1F000), *range(0x31350, 0x32400)]
    texts = ["".join(chr(rng.choice(points)) + rng.choice(["", " ", "a", "7"]) for _ in range(400)) for _ in range(60)]
    texts += ["İstanbul ΟΔΟΣ straße Ⅷ ǅ", "", None, "- _ -", "y" * 41 + " b " + "é" * 21 + " b"]
    monkeypatch.setattr(term_index, "BLOCK_CHARS", 2000)
    rows = chunk_rows(spark, texts)
    want = rows.select("chunk_id", F.explode(term_index.placed_terms(F.col("content"))).alias("t")).groupBy("chunk_id", "t.term").agg(F.sort_array(F.collect_list("t.at")).alias("at"))
    lengths = {r[0]: r[1] for r in rows.select("chunk_id", F.size(search.terms_of(F.col("content")))).collect()}
    got = term_index.positional_postings(rows, ("content",)).collect()
    assert sorted((r["chunk_id"], r["term"], r["positions"]) for r in got) == sorted(map(tuple, want.collect()))
    assert all(r["tf"] == len(r["positions"]) and r["length"] == lengths[r["chunk_id"]] for r in got)


def test_chunks_without_path_or_content(spark, tmp_path):
    rows = spark.createDataFrame([(None, "c1", "wiki", "t", "plum pear plum", 1, 1), ("d/1.md", "c1", "wiki", "t", None, 1, 1), ("d/1.md", "c2", "wiki", "t", "pear", 2, 2)], CHUNK)
    term_index.write_index(rows, f"file://{tmp_path}/i")
    ids = lambda q: sorted((r["path"] or "", r["chunk_id"]) for r in term_index.search(spark, f"file://{tmp_path}/i", q, 9).collect())
    assert ids("plum") == [("", "c1")] and ids('"pear plum"') == [("", "c1")] and ids("d/1.md")[-2:] == [("d/1.md", "c1"), ("d/1.md", "c2")] and ids("pear") == [("", "c1"), ("d/1.md", "c2")]
