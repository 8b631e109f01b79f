"""Registered queries of answers and of the functions that show them, over table texts; and the SQL of overview_answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..operators import pages
from ..operators.symbols.lines import symbol_of
from .queries import _GRAPH, _HYBRID, _PRIORITY, ORACLE, QUESTION, _nation_graph, query, table

#: What overview_answer asks, and its search terms.
ASKED, ASKED_TERMS = "What does this project do? thing", ["what", "does", "this", "project", "do", "thing"]


def _first_place() -> str:
    """The least place of a term in lower-cased content, null if there is none."""
    return "least(" + ", ".join(f"nullif(instr(lower(content), '{t}'), 0)" for t in ASKED_TERMS) + ")"


_SCORED = _HYBRID.replace(QUESTION, ASKED).replace("['thing', 'thble']", str(ASKED_TERMS)).replace(") / 2 AS text_score", f") / {len(ASKED_TERMS)} AS text_score")
_SCORED = _SCORED[: _SCORED.rindex("SELECT path, chunk_id, start_line")]
_BLANK = "' ' || chr(10)"
_ANSWER = f"""{_SCORED},
hy AS (SELECT path, chunk_id, start_line, end_line, text_score, vector_score, score, 1000 + row_number() OVER (ORDER BY score DESC, path, chunk_id) AS ord, FALSE AS whole FROM s WHERE score > 0 QUALIFY ord <= 1014),
o1 AS (SELECT path, chunk_id, start_line, end_line, {_PRIORITY} AS score FROM chunks),
o2 AS (SELECT * FROM o1 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, start_line, chunk_id) = 1),
ov AS (SELECT path, chunk_id, start_line, end_line, CAST(score AS DOUBLE) AS text_score, 0.0::DOUBLE AS vector_score, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY score DESC, path, chunk_id) AS ord, TRUE AS whole FROM o2 QUALIFY ord <= 10),
res AS (SELECT * FROM (SELECT * FROM hy UNION ALL SELECT * FROM ov) QUALIFY row_number() OVER (PARTITION BY path, chunk_id ORDER BY ord) = 1),
e AS (SELECT * FROM res WHERE score >= 0.20 AND (text_score >= 0.04 OR vector_score >= 0.20)),
c AS (
  SELECT e.*, row_number() OVER (ORDER BY score DESC, ord) AS place,
    trim(CASE WHEN whole THEN trim(substr(content, 1, 1200), {_BLANK}) ELSE trim(replace(substr(content, greatest(coalesce({_first_place()} - 1, 0) - 80, 0) + 1, 220), chr(10), ' '), {_BLANK}) END, {_BLANK}) AS snippet
  FROM e JOIN chunks USING (path, chunk_id)),
says AS (SELECT string_agg('- `' || path || ':L' || c.start_line || CASE WHEN c.start_line = c.end_line THEN '' ELSE '-L' || c.end_line END || '`: ' || CASE WHEN length(snippet) > 180 THEN substr(snippet, 1, 180) || '...' ELSE snippet END, chr(10) ORDER BY place) AS lines FROM c WHERE place <= 5),
listed AS (SELECT path FROM files ORDER BY path LIMIT 250),
main AS (SELECT string_agg('- `' || path || '`', chr(10) ORDER BY path) AS lines FROM (SELECT path FROM listed ORDER BY path LIMIT 12))
SELECT 'local-retrieval' AS provider, CAST((SELECT count(*) FROM c) AS INTEGER) AS citations,
  '## Project Overview' || chr(10) || 'This workspace has ' || (SELECT count(*) FROM listed) || ' indexed files. Based on the current index, it appears to be a code project organized around these main areas:' || chr(10) || chr(10) || '## Main Files' || chr(10) || main.lines
  || chr(10) || chr(10) || '## Likely Responsibilities' || chr(10) || says.lines || chr(10) || chr(10) || '## Code Map' || chr(10) || '- Symbol graph context is not available for the top matches yet.' AS answer
FROM says, main"""
ORACLE["overview_answer"] = _ANSWER


_LINES = "string_split(replace(text, '. ', '.' || chr(10)), chr(10))"


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform({_LINES}, lambda x: trim(x)), lambda x: x <> '') AS a FROM documents),
k AS (SELECT doc_id, list_filter(a, lambda x: NOT (starts_with(lower(x), 'import ') OR starts_with(lower(x), 'export ') OR starts_with(lower(x), 'from ') OR contains(x, '```') OR starts_with(x, '<'))) AS a FROM l)
SELECT doc_id, md5(substr(array_to_string(list_filter(a, lambda x: lower(trim(ltrim(x, '#'))) NOT IN ('assistant:', 'summary'))[1:40], chr(10)), 1, 2400)) AS clean_md5 FROM k"""
)
def clean_summaries(spark, sf_dir):
    """Every document, a sentence a line, as a generator's summary."""
    sentences = F.replace("text", F.lit(". "), F.lit(".\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_summary(sentences).cast("binary")).alias("clean_md5"))


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS links, md5(array_to_string(w, '|')) AS targets_md5 FROM (SELECT doc_id, regexp_extract_all(text, 'th[a-z]+') AS w FROM documents)")
def document_links(spark, sf_dir):
    """Documents whose words of a kind are made links."""
    linked = text.wikilinks(F.regexp_replace("text", "(th[a-z]+)", "[[ $1 ]]"))
    return table(spark, sf_dir, "documents").select("doc_id", linked.alias("w")).select("doc_id", F.size("w").cast("long").alias("links"), F.md5(F.array_join("w", "|").cast("binary")).alias("targets_md5"))


_PLACES = ["Workflow", "unit_test", "components", "Parser", "my_index", "misc"]


@query(
    f"""WITH p AS (SELECT page_id, 'src/' || {_PLACES}[page_id % 6 + 1] || '/' || page_id || '.ts' AS path FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Automation / CI behavior' WHEN 1 THEN 'Validation and quality checks' WHEN 2 THEN 'UI rendering and interaction' WHEN 5 THEN 'General project logic' ELSE 'Code intelligence and indexing' END AS purpose FROM p"""
)
def path_purposes(spark, sf_dir):
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("src/"), place, F.lit("/"), F.col("page_id").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "pages").select("page_id", paths.purpose(path).alias("purpose"))


@query(
    f"""WITH {_GRAPH}, n AS (SELECT DISTINCT id, path, name, kind, regexp_extract(path, '[^/]*$') AS file FROM g)
SELECT id, 'What does ' || file || ' do?|Explain ' || name || ' and its dependencies|Where is ' || name || ' used?|Show call flow for ' || name || '|Summarize risks and edge cases in ' || file || '|What tests cover this ' || kind || '?' AS questions FROM n"""
)
def symbol_questions(spark, sf_dir):
    """What may be asked about every symbol."""
    symbols = _nation_graph(spark, sf_dir)[1]
    return symbols.select("id", F.array_join(labels.suggested_questions("path", "name", "kind", 6), "|").alias("questions"))


@query(
    r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(trim(replace(text, ', ', ':' || chr(10)), ' ' || chr(10)), chr(10)), lambda x: rtrim(x)), chr(10)) AS t FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\n([A-Z#-])', '\1' || chr(10) || chr(10) || '\2', 'g'), chr(10)) AS a FROM t)
SELECT doc_id, md5(array_to_string(list_transform(a, lambda x: CASE WHEN trim(x) = '' THEN '' WHEN regexp_matches(trim(x), '^(#{1,6}\s|[-*]\s|\d+\.\s)') THEN x WHEN regexp_matches(trim(x), '^[A-Za-z][A-Za-z\s]+:\s*$') THEN '## ' || regexp_replace(trim(x), ':$', '') ELSE x END), chr(10))) AS shown_md5 FROM p"""
)
def formatted_responses(spark, sf_dir):
    """Every document, cut at its commas into labels, as an answer to show."""
    cut = F.replace("text", F.lit(", "), F.lit(":\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(labels.format_response(cut).cast("binary")).alias("shown_md5"))


_KINDS = ["export", "component", "import", "import", "function", "function", "method", "class", "interface", "type_alias", "enum"]
_PARTS = f"""g AS (SELECT 'src/m' || p_partkey % 20 || CASE WHEN p_partkey % 20 = 3 THEN '.json' ELSE '.ts' END AS path, CASE WHEN p_partkey % 11 = 5 THEN 'use' ELSE '' END || upper(substr(p_type, 1, 1)) || p_partkey % 90 AS name, {_KINDS}[p_partkey % 11 + 1] AS kind,
  CASE p_partkey % 11 WHEN 2 THEN 'react' WHEN 3 THEN './' || p_size END AS source, CAST(p_partkey AS BIGINT) AS start_line FROM part)"""


def _part_symbols(spark, sf_dir):
    """Parts as symbols of every kind."""
    k, n = F.col("p_partkey") % 11, F.col("p_partkey") % 20
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("src/m"), n.cast("string"), F.when(n == 3, ".json").otherwise(".ts")).alias("path"),
        F.concat(F.when(k == 5, "use").otherwise(""), F.upper(F.substring("p_type", 1, 1)), (F.col("p_partkey") % 90).cast("string")).alias("name"),
        kind.alias("kind"),
        F.when(k == 2, "react").when(k == 3, F.concat(F.lit("./"), F.col("p_size").cast("string"))).alias("source"),
        F.col("p_partkey").cast("long").alias("start_line"),
        F.lit(1).cast("long").alias("start_column"),
    )


@query(
    f"""WITH {_PARTS},
h AS (SELECT DISTINCT path, name FROM g WHERE kind = 'function' AND regexp_matches(name, '^use[A-Z]')),
u AS (
  SELECT path, 'exposed' AS section, CASE kind WHEN 'export' THEN 0 ELSE 1 END AS part, name, start_line, '- `' || name || '` (' || kind || ') at `L' || start_line || ':1`' AS line FROM g WHERE kind IN ('export', 'component')
  UNION ALL SELECT path, CASE WHEN starts_with(source, '.') THEN 'local' ELSE 'external' END, 0, name, start_line, '- `' || name || '` from `' || source || '`' FROM g WHERE kind = 'import'
  UNION ALL SELECT path, 'hooks', 0, name, start_line, '- `' || name || '` at `L' || start_line || ':1`' FROM g WHERE kind = 'function' AND regexp_matches(name, '^use[A-Z]')
  UNION ALL SELECT path, 'functions', 0, name, start_line, '- `' || name || '` at `L' || start_line || ':1`' FROM g WHERE kind = 'function' AND (path, name) NOT IN (SELECT (path, name) FROM h)
  UNION ALL SELECT path, 'methods', 0, name, start_line, '- `' || name || '` at `L' || start_line || ':1`' FROM g WHERE kind = 'method'
  UNION ALL SELECT path, 'types', CASE kind WHEN 'class' THEN 0 WHEN 'interface' THEN 1 WHEN 'type_alias' THEN 2 ELSE 3 END, name, start_line, '- `' || name || '` (' || replace(kind, '_', ' ') || ') at `L' || start_line || ':1`' FROM g WHERE kind IN ('class', 'interface', 'type_alias', 'enum')),
k AS (SELECT *, row_number() OVER (PARTITION BY path, section ORDER BY part, start_line, name) AS rank FROM u)
SELECT path, section, CAST(rank AS INTEGER) AS rank, line FROM k WHERE rank <= CASE section WHEN 'exposed' THEN 12 WHEN 'hooks' THEN 12 WHEN 'external' THEN 20 WHEN 'local' THEN 20 ELSE 16 END"""
)
def part_page_sections(spark, sf_dir):
    """Every section of a page: exports, components, local and library imports, hooks, functions, methods and types."""
    return pages.sections(_part_symbols(spark, sf_dir))


@query(
    f"""WITH {_PARTS}, n AS (SELECT path, count(*) AS symbols, count_if(kind = 'component') AS c, count_if(kind = 'function' AND regexp_matches(name, '^use[A-Z]')) AS h, count_if(kind = 'class') AS k, count_if(kind IN ('interface', 'type_alias', 'enum')) AS t FROM (
  SELECT * FROM g WHERE kind = ['component', 'function', 'class', 'enum', 'method', 'method'][CAST(substr(path, 6, 1) AS INTEGER) % 6 + 1]) GROUP BY path)
SELECT path, CAST(symbols AS BIGINT) AS symbols, CASE WHEN c > 0 THEN 'UI component module' WHEN h > 0 THEN 'React hook module' WHEN k > 0 THEN 'Object-oriented service/module' WHEN t > 0 THEN 'Type/model definition module' WHEN ends_with(path, '.json') THEN 'Configuration module' ELSE 'General utility/module' END AS profile FROM n"""
)
def part_profiles(spark, sf_dir):
    """Files with symbols of one kind each, by which a module's profile is told."""
    one = F.element_at(F.array(*[F.lit(x) for x in ("component", "function", "class", "enum", "method", "method")]), F.substring("path", 6, 1).cast("int") % 6 + 1)
    return pages.kind_counts(_part_symbols(spark, sf_dir).where(F.col("kind") == one)).select("path", "symbols", "profile")


_TAG = r"^<[&*$@]*([\p{L}\p{N}_\-.:\\]+)"


@query(
    rf"""WITH l AS (SELECT page_id, regexp_replace(unnest(string_split(replace(html, '<', chr(10) || '<'), chr(10))), '^\s+', '') AS line FROM pages)
SELECT page_id, regexp_replace(regexp_extract(line, '{_TAG}', 1), '^[;:]+|[;:]+$', '', 'g') AS name, CAST(count(*) AS BIGINT) AS n FROM l
WHERE regexp_matches(line, '^<[^/?!]') AND regexp_matches(line, '{_TAG}') GROUP BY 1, 2"""
)
def page_tags(spark, sf_dir):
    """The tags of every page, each on a line of its own."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(text.lines(F.replace("html", F.lit("<"), F.lit("\n<")))).alias("line"))
    return rows.select("page_id", symbol_of(text.trim_white_start("line"), "xml")["name"].alias("name")).where("name is not null").groupBy("page_id", "name").agg(F.count("*").alias("n"))
