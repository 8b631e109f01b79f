import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, language, ngram_join, packing, secrets


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    frame = docs
    frame = steps["language_id"](spark, frame, sf_dir)
    # the documents of the table are in learned languages; test_language holds the decoding against an independent one
    assert {r["doc_id"] for r in frame.collect()} == {d for d, t in rows.items() if any(c.isalpha() for c in t)}
    foreign = docs.limit(1).select(*[F.lit(x).cast(docs.schema[c].dataType).alias(c) for c, x in {**dict.fromkeys(columns), "doc_id": 10**9, "text": "η γάτα και ο σκύλος είναι στο σπίτι " * 5}.items()])
    seen = {r["doc_id"]: r["lang"] for r in steps["language_id"](spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).unionByName(foreign), sf_dir).collect()}
    assert 10**9 not in seen and None not in seen.values() and len(seen) >= 0.99 * len(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    first = {r[0] for r in con.execute(f"SELECT component_id FROM ({ngram_join.ORACLE})").fetchall()}
    frame = steps["ngram_jaccard_join"](spark, frame, sf_dir)
    kept = {r["doc_id"] for r in frame.collect()}
    assert kept == first and len(kept) < len(rows)
    hit = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.ORACLE}) WHERE contaminated").fetchall()}
    frame = steps["benchmark_decontamination"](spark, frame, sf_dir)
    assert {r["doc_id"] for r in frame.collect()} == kept - hit
    frame = steps["secret_scans"](spark, frame, sf_dir)
    assert frame.columns == columns
    clean = {r["doc_id"]: r for r in frame.collect()}
    assert set(clean) == kept - hit and all(len(r["text"]) == r["n_chars"] for r in clean.values())
    assert all(clean[d]["text"] == rows[d] or "[SECRET:" in clean[d]["text"] for d in clean)
    packed = {(r["doc_id"], r["piece"]): r for r in steps["packing"](spark, frame, sf_dir).collect()}
    assert {d for d, _ in packed} == set(clean)
    assert {(r["doc_id"], r["piece"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(d, p, r["n_tokens"]) for (d, p), r in packed.items()}
    assert language.UNKNOWN == "und" and packing.BUCKETS == 8 and secrets.MARKOV == "markov"


def test_stages_take_nulls_repeats_extra_columns_and_nothing(spark, sf_dir):
    long = "the thing that was " * 30_000
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, "12 !?", None, "s", 5), (4, long, "en", "s", 1), (5, "a b c d e f", "en", "s", 1), (5, "a b c d e f", "en", "s", 1), (None, "lone words here", "en", "s", 1), (6, "the thing token=abcdefghijklmnop", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, piece string, digest int"
    for given in (rows, []):
        frame = spark.createDataFrame([r + (0.5, "p", 1) for r in given], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf_dir)
            assert frame.columns == [c.split()[0] for c in schema.split(", ")], name
        left = sorted(((r["doc_id"], r["text"][-20:]) for r in frame.collect()), key=str)
        if given:
            assert left == sorted([(4, long[-20:]), (5, "a b c d e f"), (None, "lone words here"), (6, "thing [SECRET:assign]"[-20:])], key=str)
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
        assert len(packed) == (0 if not given else 3 + -(-120_000 // packing.MAX_LEN))
