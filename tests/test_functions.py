import random

from pyspark.sql import functions as F

from corpusloom.functions import labels, paths, text, vectors
from corpusloom.operators import chunks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lines_follow_line_feeds(spark):
    for raw, want in (("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""])):
        assert one(spark, text.lines(F.lit(raw)))[0] == want == chunks.split_lines(raw)


def test_words_and_terms(spark):
    assert one(spark, text.query_terms(F.lit("The the é x1 a_b! z")))[0] == ["the", "the", "é", "x1", "a_b"]
    assert one(spark, text.tokens(F.lit("activeSourcePath")))[0] == ["active", "source", "path", "activesourcepath"]


def test_score_is_by_substrings_without_overlap(spark):
    got = one(spark, text.score_text(F.lit("aaaa b"), F.array(F.lit("aa"), F.lit("b"), F.lit("zz"))))[0]
    assert round(got, 6) == round((1 + 0.6931471805599453 + 1) / 3, 6)


def test_embeddings(spark):
    near, far, query = "read the index of files", "bake bread with salt", "file index reading files"
    row = one(spark, *[vectors.embed(F.lit(t)).alias(n) for n, t in (("a", near), ("b", far), ("q", query), ("z", ""))], vectors.embed_expression(F.lit(near)).alias("same"))
    size = lambda v: sum(x * x for x in v) ** 0.5
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert len(row["a"]) == 64 and abs(size(row["a"]) - 1) < 1e-9 and size(row["z"]) == 0
    assert dot(row["a"], row["q"]) > dot(row["b"], row["q"])
    assert max(abs(x - y) for x, y in zip(row["a"], row["same"])) < 1e-12


def test_dot_of_other_lengths_is_zero(spark):
    assert one(spark, vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))[0] == 0


def test_blob_codec(spark):
    rows = spark.createDataFrame([(bytes(8),), (bytes(7),), (None,)], "b binary")
    assert [r[0] for r in rows.select(vectors.from_blob("b")).collect()] == [[0.0, 0.0], None, None]
    assert one(spark, vectors.from_json(F.lit("[1, 2.5]")))[0] == [1.0, 2.5]
    assert one(spark, F.coalesce(vectors.from_json(F.lit("no")), F.array()))[0] in ([], None)


def test_all_extensions_have_a_language(spark):
    rows = spark.createDataFrame([(f"a/b.{e}", language) for e, language in paths.EXTENSIONS.items()], "path string, want string")
    assert rows.where(paths.language("path") != F.col("want")).count() == 0
    assert len(paths.EXTENSIONS) == 42 and len(paths.LANGUAGES) == 28
    assert one(spark, paths.language(F.lit("x.PY")))[0] is None


def test_page_names_do_not_collide(spark):
    a, b = one(spark, paths.page_file_name(F.lit("src/foo.ts")), paths.page_file_name(F.lit("src_foo.ts")))
    assert a != b and a.startswith("src_foo.ts_") and a.endswith(".md")


def test_chunks_cover_all_lines():
    rng = random.Random(2)
    for _ in range(200):
        lines = [rng.choice(["", "def f():", "  class A", "x = 1", "pub fn a()"]) if rng.random() < 0.2 else "text" for _ in range(rng.randrange(400))]
        found = chunks.bounds(lines)
        seen = set()
        for (a, b), following in zip(found, found[1:] + [None]):
            assert 0 < b - a <= chunks.TARGET
            seen.update(range(a, b))
            if following:
                assert following[0] >= b - chunks.OVERLAP and following[0] > a
        assert seen == set(range(len(lines)))


def test_empty_text_is_one_chunk():
    assert list(chunks.chunks_of("a", "")) == [("chunk-0001", "a:L1-L1", "", 1, 1)]


def test_report_strings(spark):
    row = one(
        spark,
        labels.suggested_questions(F.lit("src/a.ts"), F.lit(None).cast("string"), F.lit("type_alias"), 6).alias("q"),
        labels.format_response(F.lit("One.\nTwo\nRisk notes:\n- a")).alias("r"),
        paths.purpose(F.lit("x/TestParser")).alias("p"),
        labels.escape_html(F.lit("<a b='\"'>&")).alias("h"),
        text.wikilinks(F.lit("see [[ a ]] and [[b]]")).alias("w"),
        text.clean_summary(F.lit("# Summary\nimport x\nKeep this.\n```\n<div>\n  and this  ")).alias("c"),
        labels.edge_label(F.lit("  Calls ")).alias("e"),
    )
    assert row["q"][1] == "Explain a.ts and its dependencies" and row["q"][5] == "What tests cover this type alias?"
    assert row["r"] == "One.\n\nTwo\n## Risk notes\n- a"
    assert row["p"] == "Validation and quality checks" and row["h"] == "&lt;a b=&#39;&quot;&#39;&gt;&amp;"
    assert row["w"] == ["a", "b"] and row["c"] == "Keep this.\nand this" and row["e"] == "calls"


def test_languages_and_extensions_of_odd_paths(spark):
    given = {"a.b/c": None, ".ts": None, "x.tar.gz": None, "a/b.rs": "rust", "x.": None, "": None, "a\nb.ts": None, None: None, "a.b.ts": "typescript"}
    rows = spark.createDataFrame([(p,) for p in given], "path string")
    assert {r["path"]: r["language"] for r in rows.select("path", paths.language("path").alias("language")).collect()} == given
    # one lookup: the extension is cut out once, not once a language
    assert rows.select(paths.language("path").alias("l"))._jdf.queryExecution().analyzed().toString().lower().count("substring_index") == 1


def test_tables_bound_arrow_batches_by_bytes(spark, sf_dir):
    from corpusloom.plans.queries import ARROW_BATCH, table

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    table(spark, sf_dir, "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == ARROW_BATCH
