"""Registered queries over written indexes: phrases, block-max top-k, and the scan forms of the searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, term_index
from ..sources.tables import work_path, written
from .queries import _BM25, _HYBRID, _OVERVIEW, CHUNKS, QUESTION, document_chunks, query, table


def _scores(found):
    return found.select("path", "chunk_id", F.round("score", 6).alias("score"))


def chunk_index(spark, sf_dir: str) -> str:
    """The folder of a term index of the documents' chunks."""
    path = work_path(spark, "term-index")
    term_index.write_index(written(document_chunks(spark, sf_dir), "chunks"), path)
    return path


@query(_HYBRID)
def hybrid_scan(spark, sf_dir):
    found = search.hybrid_scan(document_chunks(spark, sf_dir), QUESTION, 25)
    return found.select("path", "chunk_id", "start_line", "end_line", *[F.round(c, 6).alias(c) for c in ("text_score", "vector_score", "score")])


@query(_BM25)
def text_scan(spark, sf_dir):
    return _scores(search.bm25_scan(document_chunks(spark, sf_dir), "The ontion", 25))


@query(_OVERVIEW)
def overview_scan(spark, sf_dir):
    return search.overview_scan(document_chunks(spark, sf_dir), 20).select("path", "chunk_id", "start_line", F.round("score", 6).alias("score"), "snippet")


_RECENT = CHUNKS.replace("chunks AS (", "every AS (") + ", chunks AS (SELECT * FROM every ORDER BY md5(path) DESC, path, chunk_id LIMIT 2000)"


@query(_HYBRID.replace(CHUNKS, _RECENT))
def recent_hybrid_search(spark, sf_dir):
    """Over the last updated 2000 chunks only, times being a hash of the path."""
    rows = written(document_chunks(spark, sf_dir).withColumn("updated_at", F.md5(F.col("path").cast("binary"))), "chunks")
    found = search.hybrid_search(rows, written(search.embed_chunks(rows), "vectors"), QUESTION, 25, exact=False)
    return found.select("path", "chunk_id", "start_line", "end_line", *[F.round(c, 6).alias(c) for c in ("text_score", "vector_score", "score")])


@query(_OVERVIEW.replace(CHUNKS, CHUNKS.replace("chunks AS (", "every AS (") + ", chunks AS (SELECT * FROM every ORDER BY path, start_line LIMIT 2000)"))
def first_overview(spark, sf_dir):
    """Over the first 2000 chunks only."""
    found = search.project_overview(written(document_chunks(spark, sf_dir), "chunks"), 20, exact=False)
    return found.select("path", "chunk_id", "start_line", F.round("score", 6).alias("score"), "snippet")


@query(_BM25)
def block_max_search(spark, sf_dir):
    """text_search through the term index: the same rows, from the blocks that can hold them."""
    return _scores(term_index.search(spark, chunk_index(spark, sf_dir), "The ontion", 25))


_FIELDS = f"""{CHUNKS},
f AS (SELECT path, chunk_id, 'title' AS field, title AS t FROM chunks UNION ALL SELECT path, chunk_id, 'content', content FROM chunks),
ws AS (SELECT path, chunk_id, field, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS a FROM f),
tk AS (SELECT path, chunk_id, field, a, len(list_filter(a, lambda w: strlen(w) <= 40)) AS dl FROM ws),
st AS (SELECT field, count(*) AS n, avg(dl) AS ml FROM tk GROUP BY field)"""


#: Two phrases and a word.
PHRASES = '"of the" "The and the" ontion'
PHRASES_SQL = f"""WITH RECURSIVE {_FIELDS},
c AS (SELECT 0 AS c, ['of', 'the'] AS p UNION ALL SELECT 1, ['the', 'and', 'the'] UNION ALL SELECT 2, ['ontion']),
h AS (SELECT c, p, path, chunk_id, field, dl, len(list_filter(range(1, len(a) - len(p) + 2), lambda i: a[i:i + len(p) - 1] = p)) AS tf FROM tk, c),
w AS (SELECT DISTINCT unnest(p) AS term FROM c),
df AS (SELECT field, term, count(*) AS df FROM tk, w WHERE list_contains(a, term) GROUP BY ALL),
i AS (SELECT c, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT c, unnest(p) AS term FROM c) JOIN df USING (term) JOIN st USING (field) GROUP BY ALL),
s AS (SELECT path, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / ml))) AS score FROM h JOIN i USING (c, field) JOIN st USING (field) WHERE tf > 0 GROUP BY path, chunk_id)
SELECT path, chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, path, chunk_id LIMIT 25"""


@query(PHRASES_SQL)
def phrase_search(spark, sf_dir):
    """Two phrases and a word, by positions."""
    return _scores(term_index.search(spark, chunk_index(spark, sf_dir), PHRASES, 25))


@query(
    f"""WITH RECURSIVE {_FIELDS},
asked AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')[1:2] AS p FROM benchmark),
q AS (SELECT path, chunk_id, a[i] AS one, a[i + 1] AS two FROM (SELECT path, chunk_id, a, unnest(range(1, len(a))) AS i FROM tk WHERE field = 'content'))
SELECT item_id, path, chunk_id, CAST(count(*) AS BIGINT) AS occurrences FROM q JOIN asked ON one = p[1] AND two = p[2] GROUP BY item_id, path, chunk_id"""
)
def phrase_matches(spark, sf_dir):
    """Where the first two words of each benchmark item stand side by side, in all chunks: a table of phrases at once."""
    index = term_index.positional_postings(document_chunks(spark, sf_dir), ("content",))  # read once: only the phrases' terms go on
    words = F.filter(term_index.placed_terms(F.col("text")), lambda t: t["at"] < 2)
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clause"), words.alias("t")).where("size(t) = 2")
    wanted = phrases.select("clause", F.explode("t").alias("t")).select("clause", F.lit(2).alias("size"), "t.term", F.col("t.at").alias("offset"), F.lit("content").alias("field"))
    return term_index.phrase_matches(index, wanted).select(F.col("clause").alias("item_id"), "path", "chunk_id", F.col("tf").alias("occurrences"))
