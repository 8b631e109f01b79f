"""Cited answers: intent, evidence, citations, graph context and the answer's text.

Retrieval and ranking are DataFrames; a text is made on the driver from the few
rows that a limit leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.paths import base_name, contains_any, line_label
from ..functions.text import _WHITE, clean_summary, col, trim_white, truncate_snippet
from ..sources.tables import written
from . import graph, search
from .scans import without_adjacent_repeats

# Phrases that show what a question asks for, in order of trial.
FILE_LIST = ("give me the files", "list files", "show files", "what files", "which files", "files in this project", "file list")
OVERVIEW = (
    "what this project", "what is this project", "what does this project", "what is the project", "what does the project",
    "project doing", "explain this project", "summarize this project", "overview of this project",
)
# Thresholds of evidence and of generation (score, text score, vector score).
EVIDENCE, GENERATION = (0.20, 0.04, 0.20), (0.45, 0.08, 0.55)
CONTEXT_LIMIT, CONTEXT_RESULTS = 24, 3
DOCUMENTS, OVERVIEW_LIMIT, OVERVIEW_CHUNKS, SEARCH_LIMIT = 250, 14, 10, 8


def intent(query) -> Column:
    q = F.lower(col(query))
    return F.when(contains_any(q, FILE_LIST), "file_list").when(contains_any(q, OVERVIEW), "project_overview").otherwise("general")


def is_meaningful(query) -> Column:
    """Three letters at least, in two words or eight bytes."""
    q = trim_white(query)
    letters = F.regexp_count(q, F.lit("[A-Za-z]"))
    worded = F.size(F.filter(F.split(q, f"{_WHITE}+"), lambda w: w.rlike("[A-Za-z]")))
    return (F.octet_length(q) >= 3) & (letters >= 3) & ((worded >= 2) | (F.octet_length(q) >= 8))


def targets_path(query, path) -> Column:
    """Whether a question names a path, its file, or the file in view."""
    q, p = F.lower(col(query)), F.lower(col(path))
    return F.contains(q, p) | F.contains(q, base_name(p)) | contains_any(q, ("this file", "current file", "selected file"))


def meets(thresholds) -> Column:
    score, text, vector = thresholds
    return (F.col("score") >= score) & ((F.col("text_score") >= text) | (F.col("vector_score") >= vector))


def relevant(results: DataFrame) -> DataFrame:
    return results.where(meets(EVIDENCE))


def may_generate(results: DataFrame) -> DataFrame:
    """One row if the first result (column ord) is good enough to generate from."""
    return results.orderBy("ord").limit(1).where(meets(GENERATION))


def first_per_chunk(results: DataFrame) -> DataFrame:
    """The first row (column ord) of each path and chunk."""
    own = Window.partitionBy("path", "chunk_id").orderBy("ord")
    return results.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")


def citation_priority(active_path: str | None) -> Column:
    own = F.when(F.col("path") == active_path, 100).otherwise(0) if active_path else F.lit(0)
    source = F.when(F.startswith("path", F.lit("docs/wiki/")), 0).otherwise(20)
    return own + source + F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), 10).otherwise(0)


def rank_citations(citations: DataFrame, active_path: str | None = None) -> DataFrame:
    """Citations by priority, score and order of arrival (column ord)."""
    return citations.withColumn("priority", citation_priority(active_path)).orderBy(F.desc("priority"), F.desc("score"), "ord")


def number_citations(citations: DataFrame, active_path: str | None = None) -> DataFrame:
    """Every ranked citation with its rank from 1: its place in its sorted partition, behind the rows of those before."""
    placed = rank_citations(citations, active_path).withColumn("_at", F.monotonically_increasing_id()).cache()
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for number, n in sorted(placed.groupBy(part.alias("part")).count().collect()):  # one row a partition
        starts.append((number, before))
        before += n
    first = citations.sparkSession.createDataFrame(starts, "_part long, _before long")
    return placed.join(F.broadcast(first), part == F.col("_part")).withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")


def drop_adjacent(contexts: DataFrame, order: list[str], key: list[str], group: str | None = None) -> DataFrame:
    """Rows in order without those whose key equals that of the row before; a group of any size is spread over range partitions."""
    return without_adjacent_repeats(contexts, order, key, group)


_CONTEXT_ORDER = ["path", "name", "n", "relation", "start_line", "start_column"]


def contexts_of_results(results: DataFrame, symbols: DataFrame, edges: DataFrame, question: str = "question") -> DataFrame:
    """Graph contexts for a table of questions: question, place (from 1), relation and the symbols' columns, CONTEXT_LIMIT rows
    a question at most.

    results has question, path and ord.  The first CONTEXT_RESULTS paths of each question are looked up, each path once
    whatever the number of questions that name it; then each question's rows are sorted, adjacent repeats go, and the first
    stay.
    """
    first = Window.partitionBy(question).orderBy("ord", "path")
    asked = results.withColumn("n", F.row_number().over(first) - 1).where(F.col("n") < CONTEXT_RESULTS).select(question, "n", F.col("path").alias("target"))
    found = graph.graph_contexts(symbols, edges, asked.select("target").distinct(), CONTEXT_LIMIT)
    rows = asked.join(found, "target").select(question, "n", "relation", *graph.SYMBOL_COLUMNS)
    # at most CONTEXT_RESULTS * CONTEXT_LIMIT rows a question: its own window holds them
    own = Window.partitionBy(question).orderBy(*_CONTEXT_ORDER)
    key = F.struct("path", "relation", "name", "start_line")
    kept = rows.withColumn("_same", key.eqNullSafe(F.lag(key).over(own)) & (F.row_number().over(own) > 1)).where("not _same")
    return kept.withColumn("place", F.row_number().over(own)).where(F.col("place") <= CONTEXT_LIMIT).drop("_same", "n")


def context_of_results(results: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph context of one question's first results, sorted and without adjacent repeats."""
    found = contexts_of_results(results.withColumn("question", F.lit(0)), symbols, edges).drop("question")
    return found.orderBy("place").drop("place")


def with_focus(results: DataFrame, focused: DataFrame, query: str, path: str, is_overview: bool) -> DataFrame:
    """Results with the focused document in place of its chunks: first if the question is about it, else last."""
    rest = results.where(F.col("path") != path)
    if is_overview or not focused.head(1):
        return rest if focused.head(1) else results
    about = results.sparkSession.range(1).select(targets_path(F.lit(query), F.lit(path)).alias("x")).first()["x"]
    place = -1 if about or not rest.head(1) else 1 << 30
    return rest.unionByName(focused.withColumn("ord", F.lit(place)))


def grounded(summary: str, citations: list[dict]) -> bool:
    """Whether a summary names a cited file, or two of a citation's first longer words."""
    if not summary.strip() or not citations or len(summary.split("\n")) > 32:
        return False
    low = summary.lower()
    for c in citations[:3]:
        if c["path"].lower().rsplit("/", 1)[-1] in low:
            return True
        hits = set()
        for token in c["snippet"].split()[:10]:
            word = token
            while word and not (word[0].isascii() and (word[0].isalnum() or word[0] in "_/")):
                word = word[1:]
            while word and not (word[-1].isascii() and (word[-1].isalnum() or word[-1] in "_/")):
                word = word[:-1]
            if len(token.encode()) > 4 and len(word.encode()) > 4 and word.lower() in low:
                hits.add(word.lower())
        if len(hits) >= 2:
            return True
    return False


def presented(citations: DataFrame) -> DataFrame:
    """Citations with the strings that an answer shows of them."""
    return citations.withColumns(
        {
            "label": line_label("path", "start_line", "end_line"),
            "short": truncate_snippet("snippet"),
            "shown_kind": labels.citation_kind("snippet"),
            "role": labels.intent_explanation("title"),
            "interaction": labels.interaction("snippet"),
            "logic": labels.plain_logic("title", "snippet"),
        }
    )


# The sentences and headings of the functions that follow, which answers are compared by.


@dataclass
class Answer:
    answer: str
    citations: list[dict]
    graph_context: list[dict]
    provider: str


def fallback_summary(query: str, citations: list[dict]) -> str:
    if not citations:
        return f'I don\'t know from current index for "{query}". Rebuild search index to include more files.'
    said = [f'For "{query}", the best indexed context is in `{citations[0]["path"]}`.', "What I can confirm from local index:"]
    said += [f"- `{c['label']}`: {c['short']}" for c in citations[:2]]
    return "\n".join([*said, "If this is not the file you intended, select the target file in Explorer and ask again so I can prioritize that context."])


def file_list_answer(documents: list[dict]) -> str:
    if not documents:
        return "I don't know from current index. No indexed files are available yet."
    said = ["## Indexed Files", f"Found {len(documents)} indexed files.", "", *(f"- `{d['path']}`" for d in documents[:120])]
    return "\n".join(said + [f"- ...and {len(documents) - 120} more"] * (len(documents) > 120))


def overview_answer(query: str, documents: list[dict], citations: list[dict], context: list[dict]) -> str:
    if not documents and not citations:
        return fallback_summary(query, citations)
    responsibilities = [f"- `{c['label']}`: {c['short']}" for c in citations[:5]] or ["- The search index has file paths, but not enough text evidence for a detailed summary yet."]
    code_map = [f"- `{c['name']}` in `{c['path']}` at L{c['start_line']}" for c in context[:8]] or ["- Symbol graph context is not available for the top matches yet."]
    intro = f"This workspace has {len(documents)} indexed files. Based on the current index, it appears to be a code project organized around these main areas:"
    return "\n".join(["## Project Overview", intro, "", "## Main Files", *(f"- `{d['path']}`" for d in documents[:12]), "", "## Likely Responsibilities", *responsibilities, "", "## Code Map", *code_map])


def module_answer(summary: str, citations: list[dict]) -> str:
    name = citations[0]["path"].rsplit("/", 1)[-1] if citations else "unknown"
    said = [f"# 📂 Module: `{name}`", f"> **Summary:** {summary}", "---"]
    if not citations:
        return "\n".join([*said, "### 🔍 System Note", "No indexed evidence found yet.", "No executable logic found. This file likely contains constants, types, or documentation."])
    said += ["## 🔄 Data Lifecycle", "Evidence-backed flow from indexed snippets:", *(f"- `{c['label']}`: {c['short']}" for c in citations[:3]), ""]
    said += ["## 🧱 Structural Blueprint", "| Symbol | Type | Role | Interaction |", "| :--- | :--- | :--- | :--- |"]
    said += [*(f"| `{c['title']}` | {c['shown_kind']} | {c['role']} | {c['interaction']} |" for c in citations[:5]), "", "## 🧠 Logic Breakdown"]
    for c in citations[:3]:
        said += [f"### 🔹 {c['title']}", f"**Intent:** {c['role']}", f"**Evidence:** `{c['label']}`", c["snippet"], f"> **Translation:** {c['logic']}", ""]
    return "\n".join([*said, "## 🛠 Developer Cheat Sheet", *(f"- Start with `{c['label']}` for safe edits in this area." for c in citations[:4])])


_ASKED_FOR = {
    "project_overview": "Describe the project: what it is for, its parts, how they work together, what is risky, and where to go on.",
    "file_list": "List the files, grouped by folder.",
    "general": "Answer the question first, then explain how the code does it, what shows that, and what to look out for.",
}


def build_prompt(query: str, kind: str, documents: list[dict], citations: list[dict], context: list[dict]) -> str:
    """The text given to a generator: rules, context from the index, then the question."""
    said = [f"Use only the context below; name files and lines; say what is missing rather than guess. {_ASKED_FOR[kind]}", ""]
    if kind == "project_overview":
        said += ["Files:", *(f"- {d['path']} ({d['kind']})" for d in documents[:80]), ""]
    for i, c in enumerate(citations, 1):
        said += [f"[{i}] {c['label']}", c["snippet"], ""]
    said += [f"- {c['name']} in {c['path']} ({c['relation']})" for c in context]
    return "\n".join([*said, "", f"Question: {query}", "Answer:"])


def ask(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, *, active_path: str | None = None, generate: Callable[[str], str] | None = None, model_path: str | None = None) -> Answer:
    """Answers a question from the index; generate, if given, writes the summary and is used only where it is grounded."""
    spark = chunks.sparkSession
    kind, worth = spark.range(1).select(intent(F.lit(query)), is_meaningful(F.lit(query))).first()
    overview = kind == "project_overview"
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "path", "chunk_id")
    numbered = lambda df, base: df.withColumn("ord", F.row_number().over(order) + base)  # noqa: E731  few rows: limits came first
    results = numbered(search.hybrid_search(chunks, embeddings, query, OVERVIEW_LIMIT if overview else SEARCH_LIMIT, model_path=model_path), 1000)
    if overview:
        results = first_per_chunk(numbered(search.project_overview(chunks, OVERVIEW_CHUNKS), 0).unionByName(results))
    focused = None
    if active_path:
        focused = search.document_for_path(documents, active_path, query)
        results = with_focus(results, focused, query, active_path, overview)
    results = written(relevant(results), "results")  # searched once; citations and graph context both read them
    shown = presented(rank_citations(results, active_path)).collect()
    citations = [r.asDict() for r in shown]
    if not citations and focused is not None:
        citations = [r.asDict() for r in presented(focused).collect()]
    context = [r.asDict() for r in context_of_results(results, symbols, edges).collect()]
    listed = [r.asDict() for r in search.indexed_documents(documents, DOCUMENTS).collect()]
    if kind == "file_list":
        cited = [{"path": d["path"], "title": d["title"], "snippet": f"Indexed {d['kind']} file", "start_line": None, "end_line": None, "score": 1.0} for d in listed[:12]]
        return Answer(file_list_answer(listed), cited, context, "local-index")
    said = None
    if generate is not None and worth and (overview or may_generate(results).head(1)):
        try:
            said = generate(build_prompt(query, kind, listed, citations, context))
        except Exception:  # a generator that fails leaves the answer to retrieval
            said = None
    provider = "local-retrieval" if said is None else "generator"
    if overview and said is None:
        return Answer(overview_answer(query, listed, citations, context), citations, context, provider)
    summary = spark.range(1).select(clean_summary(F.lit(said))).first()[0] if said is not None else ""
    summary = summary if grounded(summary, citations) else fallback_summary(query, citations)
    return Answer(module_answer(summary, citations), citations, context, provider)
