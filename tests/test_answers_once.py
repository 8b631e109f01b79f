"""An answer reads its vectors once, and texts embed the same in batches as alone."""

from pyspark.sql import functions as F

from corpusloom.functions import text, vectors
from corpusloom.operators import answers

CHUNK = "path string, chunk_id string, kind string, title string, content string, start_line long, end_line long"
SYMBOL = "path string, name string, kind string, parent string, source string, start_line long, start_column long, end_line long, end_column long, id string"


def test_an_answer_searches_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"src/m{i}.ts", "chunk-0001", "code", f"m{i}.ts", f"what this project does: thing {i}", 1, 1) for i in range(30)], CHUNK)
    near = rows.select("path", "chunk_id", vectors.embed(F.concat_ws("\n", "path", "title", "content")).alias("vector")).mapInArrow(counted, "path string, chunk_id string, vector array<double>")
    none = spark.createDataFrame([], SYMBOL), spark.createDataFrame([], "file_path string, symbol_id string")
    said = answers.ask(rows, near, rows.select("path", "kind", "title", "content"), *none, "What does this project do? thing")
    assert said.citations and read.value == 30


def test_embedding_of_odd_words(spark):
    odd = ["fooBar ABCd getHTTPResponse x", "é İA ΟΔΟΣ straßeA ǅ _a 7", "", "A", "aB", "Plain plain PLAIN", "-"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for a, b in rows.select(vectors.embed("t").alias("a"), vectors.embed_expression(F.col("t")).alias("b")).collect():
        assert [round(x, 12) for x in a] == [round(x, 12) for x in b]


def test_score_of_no_terms_and_null_text(spark):
    terms = F.array(F.lit("ab"), F.lit("zz"))
    rows = spark.createDataFrame([("xab ab",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(F.round(text.score_text("t", terms), 6)).collect()]
    assert got == [0.846574, 0.0, 0.0]
    assert rows.select(text.score_text("t", F.array().cast("array<string>"))).first()[0] == 0.0
