"""Proofs, roots and folds against a tree built in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def climb(nodes, paths):
    """nodes: (digest, members); one digest is left; each member's path gets (left, right) of every run."""
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            digests = [d for d, _ in run]
            for j, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append((digests[:j], digests[j + 1 :]))
            above.append((sha(*digests), [m for _, members in run for m in members]))
        nodes = above
    return nodes[0]


def brute(rows):
    groups, paths, held, tops = {}, {}, {}, []
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        for k, r in enumerate(own):
            paths[s, k], held[s, k] = [], r
        tops.append(climb([(leaf(r, r["text"]), [(s, k)]) for k, r in enumerate(own)], paths))
    subroots = {m: d for d, members in tops for m in members}
    root = climb(tops, paths)[0]
    out = []
    for m, r in held.items():
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        folded = leaf(r, text)
        for left, right in paths[m]:
            folded = sha(*left, folded, *right)
        out.append((r["doc_id"], leaf(r, r["text"]), subroots[m], root, sha(*[d for a, b in paths[m] for d in a + b]), folded, folded == root))
    return sorted(out, key=str)


def same(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle.manifest_report(df).collect()), key=str) == brute([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28])
def test_one_source(spark, n):
    same(spark, [(i, f"a\n{i}", "en", "s", 3) for i in range(n)])


def test_sources_of_one_leaf_and_a_null_one(spark):
    same(spark, [(i, "a\n", "en", f"s{i}" if i else None, None) for i in range(7)])


def test_repeats_nulls_and_unequal_sources(spark):
    rows = [(1, "a\n", "en", "s", None)] * 20 + [(None, None, None, None, None)] * 5
    rows += [(2, "é\n", None, "t", 4), (2, "", "x", "t", 4), (3, "-", "-", "é", 0), (4, "x" * 100_000, "-", "z", 0)]
    same(spark, rows)


def test_no_rows_and_extra_columns(spark):
    assert merkle.manifest_report(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(i, "a\n", "en", "s", 1) for i in range(5)], SCHEMA)
    more = df.select("*", *[F.lit("x").alias(c) for c in ("leaf", "tampered", "root", "id", "place", "tree")])
    assert sorted(map(tuple, merkle.manifest_report(more).collect())) == sorted(map(tuple, merkle.manifest_report(df).collect()))


def test_broadcast_and_shuffle_give_the_same(spark, monkeypatch):
    rows = [(i, f"a\n{i % 5}", "en", f"s{i % 4}", 3) for i in range(60)]
    for bound in ("BROADCAST_SOURCES", "BROADCAST_TARGETS"):
        monkeypatch.setattr(merkle, bound, 0)
    same(spark, rows)


def test_every_kind_of_change_breaks_a_proof(spark):
    df = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 5) for i in range(30)], SCHEMA)
    held = merkle.manifest(df.select("source", "doc_id", merkle.leaf_digest().alias("leaf")))
    by_id = {r["id"]: r for r in held.collect()}

    def folded(leaf_bytes, segments):
        digest = leaf_bytes.hex()
        for s in segments:
            digest = sha(*[d.hex() for d in s["left"]], digest, *[d.hex() for d in s["right"]])
        return digest

    root = by_id[0]["root"].hex()
    assert all(folded(r["leaf"], r["segments"]) == root for r in by_id.values())
    assert folded(by_id[1]["leaf"], by_id[0]["segments"]) != root
    assert folded(hashlib.sha256(b"other").digest(), by_id[0]["segments"]) != root
    assert max(len(r["segments"]) for r in by_id.values()) == 3 + 1  # 10 leaves a source: three levels, one above


def test_query_against_a_tree_in_python(spark, sf_dir):
    from corpusloom.llm import queries

    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op12_merkle_manifest"](spark, sf_dir).collect()), key=str) == brute(rows)
