"""Keyword, vector, hybrid and overview search over chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import onnx, vectors
from ..functions.paths import base_name, contains_any
from ..functions.text import context_snippet, haystack, query_terms, score_text, snippet
from ..sources.tables import written

# Weights, and how many rows a search looks at.
TEXT_WEIGHT, VECTOR_WEIGHT = 0.65, 0.35
SCAN_FACTOR, SCAN_LEAST, SCAN_MOST = 50, 2_000, 10_000
# BM25 as usual.
K1, B = 1.2, 0.75
#: Longest indexed term, in bytes.
TERM_BYTES = 40
RESULT = ["path", "chunk_id", "kind", "title", "snippet", "start_line", "end_line", "text_score", "vector_score", "score"]


def scan_limit(limit: int) -> int:
    return max(SCAN_LEAST, min(SCAN_MOST, limit * SCAN_FACTOR))


def sanitize_limit(value) -> int:
    """A result limit from outside: a whole number from 1 to 100."""
    try:
        n = int(float(value))
    except (TypeError, ValueError, OverflowError):
        return 1
    return max(1, min(100, n))


def query_vector(spark: SparkSession, query: str, model_path: str | None = None) -> list[float]:
    """The query's vector: by the model where there is one, else by hash."""
    if onnx.available(model_path):
        return spark.range(1).select(onnx.embed_with(model_path, F.lit(query)).alias("v")).first()["v"]
    return spark.range(1).select(vectors.embed_expression(F.lit(query)).alias("v")).first()["v"]


def query_words(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]


def no_results(chunks: DataFrame) -> DataFrame:
    """Results without rows."""
    score = [F.lit(0.0).alias(c) for c in ("text_score", "vector_score", "score")]
    return chunks.limit(0).select("path", "chunk_id", "kind", "title", F.col("content").alias("snippet"), "start_line", "end_line", *score)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def embed_chunks(chunks: DataFrame, model_path: str | None = None) -> DataFrame:
    """path, chunk_id, vector of each chunk; embedded is its path, title and content, by the model where there is one."""
    text = F.concat_ws("\n", "path", "title", "content")
    return chunks.select("path", "chunk_id", onnx.embed_with(model_path, text).alias("vector"))


def embed_documents(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """path, dimensions, magnitude, vector, updated_at of each document; embedded is its path, title and whole content."""
    rows = documents.select("path", "updated_at", onnx.embed_with(model_path, F.concat_ws("\n", "path", "title", "content")).alias("vector"))
    return rows.select("path", F.size("vector").alias("dimensions"), vectors.magnitude("vector").alias("magnitude"), "vector", "updated_at")


def top(results: DataFrame, limit: int, *ties: str) -> DataFrame:
    """Best scores first; ties by path, then by the named columns."""
    return results.orderBy(F.desc("score"), "path", *ties).limit(limit)


def hybrid_search(chunks: DataFrame, embeddings: DataFrame, query: str, limit: int = 10, *, exact: bool = True, model_path: str | None = None) -> DataFrame:
    """0.65 of the keyword score and 0.35 of the vector score; rows without score go.

    exact looks at every chunk; else only at scan_limit(limit) of the last updated (column updated_at).
    model_path is that of the embeddings; vectors of another length score 0.
    """
    spark = chunks.sparkSession
    terms, vector = _strings(query_words(spark, query)), F.array(*[F.lit(x) for x in query_vector(spark, query, model_path)])
    rows = chunks if exact else chunks.orderBy(F.desc("updated_at"), "path", "chunk_id").limit(scan_limit(limit))
    words = rows.select("path", "chunk_id", score_text(haystack("title", "content"), terms).alias("text_score"))
    near = embeddings.select("path", "chunk_id", F.greatest(vectors.dot("vector", vector), F.lit(0.0)).alias("vector_score"))
    # two numbers a chunk are shuffled; contents are fetched for the best only
    scored = words.join(near, ["path", "chunk_id"], "left").withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0)))
    return _fetched(rows, scored, terms, limit)


def hybrid_scan(chunks: DataFrame, query: str, limit: int = 10, *, model_path: str | None = None) -> DataFrame:
    """hybrid_search over chunks that have no written vectors: each is embedded and scored where it lies, without a join."""
    spark = chunks.sparkSession
    terms, vector = _strings(query_words(spark, query)), F.array(*[F.lit(x) for x in query_vector(spark, query, model_path)])
    own = onnx.embed_with(model_path, F.concat_ws("\n", "path", "title", "content"))
    scored = chunks.select("*", score_text(haystack("title", "content"), terms).alias("text_score"), F.greatest(vectors.dot(own, vector), F.lit(0.0)).alias("vector_score"))
    scored = scored.withColumn("score", F.col("text_score") * TEXT_WEIGHT + F.col("vector_score") * VECTOR_WEIGHT)
    # a task hands on its best limit rows only; a filter before would embed each text a second time
    return top(scored, limit, "chunk_id").where("score > 0").withColumn("snippet", snippet("content", terms)).select(*RESULT)


def _fetched(chunks: DataFrame, scored: DataFrame, terms: Column, limit: int) -> DataFrame:
    """The best of (path, chunk_id, text_score, vector_score) with the columns of their chunks."""
    scored = scored.withColumn("score", F.col("text_score") * TEXT_WEIGHT + F.col("vector_score") * VECTOR_WEIGHT).where("score > 0")
    best = top(scored, limit, "chunk_id")
    found = chunks.join(F.broadcast(best), ["path", "chunk_id"])  # limit rows
    return top(found.withColumn("snippet", snippet("content", terms)).select(*RESULT), limit, "chunk_id")


def terms_of(c) -> Column:
    """Index terms: lower-cased runs of letters and numbers of at most TERM_BYTES bytes."""
    return F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= TERM_BYTES))


def _counted(words) -> Column:
    """(term, tf) of each distinct word of an array: sorted, words are runs, and a run ends where the next word differs."""
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates value once
    ends = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, e: F.zip_with(e, F.concat(F.array(F.lit(0)), e), lambda i, before: F.when(i.isNotNull(), F.struct(F.get(w, i - 1).alias("term"), (i - before).cast("long").alias("tf"))))
    whole = lambda w: let(ends(w), lambda e: F.slice(runs(w, e), F.lit(1), F.size(e)))
    return let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, whole(w)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>")))


def postings(chunks: DataFrame, fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """term, field, path, chunk_id, tf, length: the inverted index of the fields, counted within each chunk."""
    words = F.array(*[F.struct(F.lit(f).alias("field"), terms_of(F.col(f)).alias("terms")) for f in fields])
    rows = chunks.select("path", "chunk_id", F.explode(words).alias("f")).select("path", "chunk_id", "f.field", F.size("f.terms").cast("long").alias("length"), F.col("f.terms").alias("terms"))
    return rows.select("path", "chunk_id", "field", "length", F.explode(_counted(F.col("terms"))).alias("t")).select("t.term", "field", "path", "chunk_id", "t.tf", "length")


def field_stats(chunks: DataFrame) -> DataFrame:
    """field, n, mean_length: one row per field."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size(terms_of(F.col("title")))).alias("title"), F.avg(F.size(terms_of(F.col("content")))).alias("content")
    ).select("n", F.expr("stack(2, 'title', title, 'content', content) as (field, mean_length)"))


def bm25_search(chunks: DataFrame, index: DataFrame, stats: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Any of the query's terms, BM25 summed over terms and fields; a word that is a whole path scores its chunks as one exact term.

    Only the postings of the query's terms are read; document frequencies come from them.
    """
    spark = chunks.sparkSession
    named = chunks.where(F.col("path").isin(*query.split())).select("path", "chunk_id") if query.split() else chunks.limit(0).select("path", "chunk_id")
    wanted = query_index_terms(spark, query)
    hits = index.where(F.col("term").isin(*wanted) if wanted else F.lit(False))
    df = hits.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    weighed = hits.join(F.broadcast(df), ["term", "field"]).join(F.broadcast(stats), "field")  # both: a few rows of the query's terms
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    of_path = named.join(F.broadcast(named.groupBy("path").agg(F.count(F.lit(1)).alias("df"))), "path")  # the query's words
    total = F.broadcast(stats.where("field = 'content'").select("n"))  # one row
    whole = of_path.crossJoin(total).select("path", "chunk_id", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("part"))
    parts = weighed.select("path", "chunk_id", part.alias("part")).unionByName(whole)
    scored = parts.groupBy("path", "chunk_id").agg(F.sum("part").alias("score"))
    best = top(scored, limit, "chunk_id")
    terms = _strings(query_words(spark, query))
    found = chunks.join(F.broadcast(best), ["path", "chunk_id"])  # limit rows
    done = found.select("path", "chunk_id", "kind", "title", snippet("content", terms).alias("snippet"), "start_line", "end_line", F.col("score").alias("text_score"), F.lit(0.0).alias("vector_score"), "score")
    return top(done, limit, "chunk_id")


def bm25_scan(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """path, chunk_id, score as bm25_search gives them, over chunks that have no written index: one pass counts lengths and the query's terms."""
    wanted = query_index_terms(chunks.sparkSession, query)
    own = chunks.select("path", "chunk_id", terms_of(F.col("title")).alias("title"), terms_of(F.col("content")).alias("content"))
    times = lambda words: F.transform(_strings(wanted), lambda t: F.size(F.filter(words, lambda w: w == t)))
    seen = own.select("path", "chunk_id", *[c for f in ("title", "content") for c in (F.size(f).alias(f"{f}_length"), times(F.col(f)).alias(f"{f}_tf"))])
    seen = written(seen, "bm25")
    held = seen.agg(F.count(F.lit(1)).alias("n"), *[c for f in ("title", "content") for c in (F.avg(f"{f}_length").alias(f"{f}_mean"), *[F.count_if(F.get(f"{f}_tf", i) > 0).alias(f"{f}_{i}") for i in range(len(wanted))])]).first()
    score = F.lit(0.0)
    for f in ("title", "content"):
        for i in range(len(wanted)):
            idf = math.log(1 + (held["n"] - held[f"{f}_{i}"] + 0.5) / (held[f"{f}_{i}"] + 0.5))
            tf = F.get(f"{f}_tf", i)
            score += F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"{f}_length") / F.lit(held[f"{f}_mean"])))).otherwise(0.0)
    return top(seen.select("path", "chunk_id", score.alias("score")).where("score > 0"), limit, "chunk_id")


# Names and words that make a chunk part of a project's overview.
MANIFESTS = ("readme.md", "package.json", "cargo.toml", "tauri.conf.json", "pyproject.toml", "requirements.txt", "dockerfile")
ENTRY_POINTS = ("main.rs", "main.ts", "main.tsx", "app.tsx", "app.ts", "mod.rs", "__init__.py")
CORE_PATHS = ("indexer", "search", "llm", "parser", "commands", "api")
CORE_WORDS = ("tauri", "react", "index", "search", "parse")


def overview_priority(path, chunk_id, start_line, content, extra_words: tuple[str, ...] = ()) -> Column:
    """How much a chunk tells about a whole project; extra_words are phrases of its own name."""
    p, text = F.lower(F.col(path)), F.lower(F.col(content))
    source = p.rlike(r"(^|/)src(-tauri)?/")
    some = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return (
        some(base_name(p).isin(*MANIFESTS), 1.0)
        + some(base_name(p).isin(*ENTRY_POINTS), 0.75)
        + some(source, 0.25)
        + some(contains_any(p, CORE_PATHS), 0.55)
        + some(contains_any(text, CORE_WORDS + extra_words), 0.35)
        + some((F.col(start_line) == 1) | F.endswith(F.col(chunk_id), F.lit("-0080")), 0.25)
    )


def query_index_terms(spark: SparkSession, query: str) -> list[str]:
    """The index terms of a query."""
    return sorted(set(spark.range(1).select(terms_of(F.lit(query)).alias("t")).first()["t"]))


def first_per_path(results: DataFrame, *order) -> DataFrame:
    """The first row of each path in the given order."""
    best = Window.partitionBy("path").orderBy(*order)
    return results.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def project_overview(chunks: DataFrame, limit: int = 10, *, exact: bool = True) -> DataFrame:
    """The best chunk of each path by overview priority."""
    rows = chunks if exact else chunks.orderBy("path", "start_line").limit(scan_limit(limit))
    scored = rows.withColumn("score", overview_priority("path", "chunk_id", "start_line", "content")).where("score > 0")
    # contents are not shuffled: the best chunk of a path is a maximum over narrow columns, and limit chunks are fetched
    order = F.struct("score", (-F.col("start_line")).alias("early"))
    tie = scored.groupBy("path", "start_line", "score").agg(F.min("chunk_id").alias("chunk_id"))
    best = tie.groupBy("path").agg(F.max_by("chunk_id", order).alias("chunk_id"), F.max("score").alias("score"))
    found = rows.join(F.broadcast(top(best, limit)), ["path", "chunk_id"])  # limit rows
    done = found.select("path", "chunk_id", "kind", "title", context_snippet("content").alias("snippet"), "start_line", "end_line", F.col("score").alias("text_score"), F.lit(0.0).alias("vector_score"), "score")
    return top(done, limit)


def overview_scan(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """project_overview over chunks that are not written: one pass, as each path's chunks lie in one task or are merged as single rows."""
    kept = ["path", "chunk_id", "kind", "title", "content", "start_line", "end_line"]
    scored = chunks.select(*kept, overview_priority("path", "chunk_id", "start_line", "content").alias("score")).where("score > 0")
    first = F.struct(F.col("score"), (-F.col("start_line")).alias("early"))
    best = scored.select("path", first.alias("rank"), F.struct("chunk_id", "kind", "title", context_snippet("content").alias("snippet"), "start_line", "end_line", "score").alias("row"))
    best = best.groupBy("path").agg(F.max_by("row", "rank").alias("row")).select("path", "row.*")
    return top(best, limit).select("path", "chunk_id", "kind", "title", "snippet", "start_line", "end_line", F.col("score").alias("text_score"), F.lit(0.0).alias("vector_score"), "score")


def document_for_path(documents: DataFrame, path: str, query: str) -> DataFrame:
    """The document itself as a result of score 1."""
    terms = _strings(query_words(documents.sparkSession, query))
    one = F.lit(1.0)
    none = F.lit(None)
    return documents.where(F.col("path") == path).limit(1).select(
        "path", none.cast("string").alias("chunk_id"), "kind", "title", snippet("content", terms).alias("snippet"), none.cast("long").alias("start_line"), none.cast("long").alias("end_line"), one.alias("text_score"), one.alias("vector_score"), one.alias("score")
    )


def indexed_documents(documents: DataFrame, limit: int) -> DataFrame:
    return documents.select("path", "kind", "title").orderBy("path").limit(limit)


def vector_search(rows: DataFrame, vector: list[float], limit: int = 10, *, key: str = "path", column: str = "vector") -> DataFrame:
    """The limit rows of greatest dot product with a vector, by a scan of all."""
    score = F.greatest(vectors.dot(F.col(column).cast("array<double>"), F.array(*[F.lit(float(x)) for x in vector])), F.lit(0.0))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def index_summary(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """documents_indexed, embeddings_indexed."""
    return documents.agg(F.count(F.lit(1)).alias("documents_indexed")).crossJoin(embeddings.agg(F.count(F.lit(1)).alias("embeddings_indexed")))  # one row each
