"""What a client shows of the tables: searches, lists, normalised rows, generated types, sanitised markup."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.paths import base_name, page_label
from ..functions.text import col


def search_names(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds the query, whatever the case; all rows for a blank one."""
    q = query.strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(q))) if q else rows


def page_items(files: DataFrame) -> DataFrame:
    """path, label of each file that is not deleted."""
    return files.where("status <> 'deleted'").select("path", page_label("path").alias("label"))


def existing_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The candidates (path) that are files."""
    return candidates.join(files.select("path").distinct(), "path", "left_semi")


CITATION_JSON = "array<struct<path:string,title:string,snippet:string,startLine:long,endLine:long,score:double>>"
CONTEXT_JSON = "array<struct<path:string,relation:string,symbol:struct<name:string,kind:string,parent:string,source:string,range:struct<startLine:long,startColumn:long,endLine:long,endColumn:long>>>>"


def normalize_citations(rows: DataFrame, column: str) -> DataFrame:
    """JSON citations as rows: those without a path go, what is missing is filled."""
    one = rows.select(F.explode(F.from_json(column, CITATION_JSON)).alias("c")).where("c.path is not null and c.path <> ''")
    return one.select(
        F.col("c.path").alias("path"), F.coalesce("c.title", base_name("c.path")).alias("title"), F.coalesce("c.snippet", F.lit("")).alias("snippet"),
        F.col("c.startLine").alias("start_line"), F.col("c.endLine").alias("end_line"), F.coalesce("c.score", F.lit(0.0)).alias("score"),
    )


def normalize_context(rows: DataFrame, column: str) -> DataFrame:
    """JSON graph context as rows, filled likewise."""
    one = rows.select(F.explode(F.from_json(column, CONTEXT_JSON)).alias("c")).where("c.path is not null and c.path <> ''")
    place = lambda name, otherwise: F.coalesce(f"c.symbol.range.{name}", F.lit(otherwise).cast("long"))
    return one.select(
        F.col("c.path").alias("path"), F.coalesce("c.relation", F.lit("related")).alias("relation"), F.coalesce("c.symbol.name", base_name("c.path")).alias("name"), F.coalesce("c.symbol.kind", F.lit("function")).alias("kind"),
        place("startLine", 1).alias("start_line"), place("startColumn", 0).alias("start_column"), place("endLine", 1).alias("end_line"), place("endColumn", 0).alias("end_column"),
    )


def interface_texts(columns: DataFrame) -> DataFrame:
    """table_name, text: a TypeScript interface of each table's columns (table_name, position, name, data_type, is_nullable)."""
    plain = labels.valid_identifier("name") & ~F.col("name").isin(*labels.RESERVED)
    key = F.when(plain, F.col("name")).otherwise(F.concat(F.lit('"'), F.replace(F.replace(F.col("name"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    line = F.concat(F.lit("  "), key, F.lit(": "), labels.typescript_type("data_type", "is_nullable"), F.lit(";"))
    grouped = columns.select("table_name", F.struct("position", line.alias("line")).alias("l")).groupBy("table_name").agg(F.sort_array(F.collect_list("l")).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return grouped.select("table_name", F.concat(F.lit("export interface "), labels.identifier("table_name"), F.lit(" {\n"), body, F.lit("\n}")).alias("text"))


def line_chip(start, end) -> Column:
    """L5 or L5 - L9."""
    s, e = col(start), col(end)
    return F.when(e.isNotNull() & (e != 0) & (e != s), F.concat(F.lit("L"), s.cast("string"), F.lit(" - L"), e.cast("string"))).otherwise(F.concat(F.lit("L"), s.cast("string")))


def status_progress(status) -> dict[str, Column]:
    """percent and detail of a status line such as `35% · Parsing`; 5 for other lines."""
    # fixed value
    pattern = r"^(\d+(?:\.\d+)?)%\s*·\s*(.+)$"
    hit = col(status).rlike(pattern)
    percent = F.when(hit, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.regexp_extract(col(status), pattern, 1).try_cast("double")))).otherwise(5.0)
    return {"percent": percent, "detail": F.when(hit, F.regexp_extract(col(status), pattern, 2)).otherwise(col(status))}


# Elements that are dropped with all they hold, and elements without an end tag.
DROPPED = ("script", "style", "iframe", "object", "embed", "link", "meta")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropping: list[str] = []

    def handle_starttag(self, tag, attributes):
        if tag in DROPPED:
            if tag not in VOID:
                self.dropping.append(tag)
        elif not self.dropping and tag not in ("html", "head", "body"):
            kept = [(k, v) for k, v in attributes if not k.startswith("on") and not (v or "").strip().lower().startswith("javascript:")]
            self.out.append(f"<{tag}{''.join(f' {k}="{escape(v or '')}"' for k, v in kept)}>")

    def handle_endtag(self, tag):
        if self.dropping and tag == self.dropping[-1]:
            self.dropping.pop()
        elif not self.dropping and tag not in VOID and tag not in DROPPED and tag not in ("html", "head", "body"):
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.dropping:
            self.out.append(escape(data, quote=False))


def clean_html(markup: str) -> str:
    cleaner = _Cleaner()
    cleaner.feed(markup)
    cleaner.close()
    return "".join(cleaner.out)


def _clean_batch(markup: pd.Series) -> pd.Series:
    return markup.map(lambda x: None if x is None else clean_html(x))


def sanitize_html(markup) -> Column:
    """Markup without scripts, styles, embedded objects, event attributes and javascript: addresses."""
    return F.pandas_udf(_clean_batch, "string")(col(markup))


def linked_pages(markup) -> Column:
    """[[name]] as a link button."""
    return F.regexp_replace(col(markup), r"\[\[\s*([^\]]+?)\s*\]\]", '<button type="button" class="wikilink" data-node="$1">$1</button>')
