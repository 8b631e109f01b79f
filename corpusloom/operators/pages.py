"""Generated pages: one markdown page per source file, from its symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.paths import page_file_name

# Most entries of each section.
MOST = {"exposed": 12, "external": 20, "local": 20, "hooks": 12, "functions": 16, "methods": 16, "types": 16}
_TYPES = ("class", "interface", "type_alias", "enum")


def kind_counts(symbols: DataFrame) -> DataFrame:
    """Per file: symbols of each kind, hooks, types and the module's profile."""
    n = lambda c: F.count_if(c).cast("long")
    rows = symbols.groupBy("path").agg(
        F.count(F.lit(1)).alias("symbols"),
        *[n(F.col("kind") == k).alias(f"n_{k}") for k in labels.KINDS],
        n(labels.is_hook("kind", "name")).alias("n_hook"),
    )
    models = F.col("n_interface") + F.col("n_type_alias") + F.col("n_enum")
    return rows.withColumn("n_types", models + F.col("n_class")).withColumn("profile", labels.module_profile("path", "n_component", "n_hook", "n_class", models))


def sections(symbols: DataFrame) -> DataFrame:
    """path, section, rank, line: the entries of each page, cut to the section's most."""
    place = F.concat(F.lit(" at `L"), F.col("start_line").cast("string"), F.lit(":"), F.col("start_column").cast("string"), F.lit("`"))
    plain = F.concat(F.lit("- `"), F.col("name"), F.lit("`"), place)
    kinded = F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), labels.human_kind("kind"), F.lit(")"), place)
    sourced = F.concat(F.lit("- `"), F.col("name"), F.lit("` from `"), F.coalesce("source", F.lit("unknown")), F.lit("`"))
    local = F.coalesce(F.startswith("source", F.lit(".")) | F.startswith("source", F.lit("/")), F.lit(False))
    kind, hook = F.col("kind"), labels.is_hook("kind", "name")
    hooks = symbols.where(hook).select("path", "name").distinct().withColumn("_hook", F.lit(True))
    rows = symbols.join(hooks, ["path", "name"], "left")
    entry = lambda section, rank, line: F.struct(F.lit(section).alias("section"), F.lit(rank).alias("part"), line.alias("line"))
    type_rank = sum((F.when(kind == k, i).otherwise(0) for i, k in enumerate(_TYPES)), F.lit(0))
    made = F.filter(
        F.array(
            F.when(kind == "export", entry("exposed", 0, kinded)),
            F.when(kind == "component", entry("exposed", 1, kinded)),
            F.when((kind == "import") & ~local, entry("external", 0, sourced)),
            F.when((kind == "import") & local, entry("local", 0, sourced)),
            F.when(hook, entry("hooks", 0, plain)),
            F.when((kind == "function") & F.col("_hook").isNull(), entry("functions", 0, plain)),
            F.when(kind == "method", entry("methods", 0, plain)),
            F.when(kind.isin(*_TYPES), F.struct(F.lit("types").alias("section"), type_rank.alias("part"), kinded.alias("line"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.select("path", "start_line", "start_column", "name", F.explode(made).alias("e")).select("path", "start_line", "start_column", "name", "e.*")
    order = Window.partitionBy("path", "section").orderBy("part", "start_line", "start_column", "name")
    most = F.create_map(*[x for k, v in MOST.items() for x in (F.lit(k), F.lit(v))])
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most[F.col("section")]).select("path", "section", "rank", "line")


def render_pages(symbols: DataFrame) -> DataFrame:
    """path, file_name, markdown of every file with symbols."""
    grouped = sections(symbols).groupBy("path", "section").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("rows"))
    by_path = grouped.select("path", "section", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("s"))
    rows = kind_counts(symbols).join(by_path, "path", "left")
    bold = lambda name, label: F.concat(F.lit("**"), F.col(name).cast("string"), F.lit(f" {label}**"))

    def told(name: str, otherwise: str) -> Column:
        return F.coalesce(F.try_element_at("s", F.lit(name)), F.lit(otherwise))

    def titled(name: str, title: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"### {title}\n"), F.try_element_at("s", F.lit(name)), F.lit("\n\n")), F.lit(""))

    # fixed values: headings and sentences of a page
    page = F.concat(
        F.lit("# `"), F.col("path"), F.lit("`\n\n> Generated from local parser symbols ("), F.col("symbols").cast("string"), F.lit(" found). This page summarizes structure and likely responsibilities.\n\n"),
        F.lit("## Quick Summary\n\n- Role: **"), F.col("profile"), F.lit("**\n- Structure: "),
        F.concat_ws(", ", bold("n_component", "components"), bold("n_function", "functions"), bold("n_method", "methods"), bold("n_types", "types"), bold("n_import", "imports")),
        F.lit("\n\n## Exposed API and Entry Points\n\n"), told("exposed", "- No explicit exports were detected in parser output for this file."),
        F.lit("\n\n## Dependencies\n\n### External Libraries\n"), told("external", "- No external package imports detected."),
        F.lit("\n\n### Local Module Links\n"), told("local", "- No relative/local imports detected."),
        F.lit("\n\n## Internal Implementation\n\n"),
        titled("hooks", "Hooks"), titled("functions", "Functions"), titled("methods", "Methods"), titled("types", "Types and Models"),
    )
    return rows.select("path", page_file_name("path").alias("file_name"), page.alias("markdown"))


def index_page(pages: DataFrame) -> DataFrame:
    """path, line: the entries of the index page, in path order."""
    return pages.select("path", F.concat(F.lit("- [`"), F.col("path"), F.lit("`]("), F.col("file_name"), F.lit(")")).alias("line")).orderBy("path")


def outline(pages: DataFrame) -> DataFrame:
    """path, position, level, title, anchor of each heading of levels 1 to 3; repeated anchors are numbered."""
    from ..functions.text import heading_slug, strip_tags

    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"), F.lit(0))
    rows = pages.select("path", F.posexplode(found).alias("position", "tag"))
    rows = rows.select("path", "position", F.substring("tag", 3, 1).cast("int").alias("level"), F.trim(strip_tags("tag")).alias("title")).withColumn("slug", heading_slug("title"))
    own = Window.partitionBy("path", "slug").orderBy("position")
    n = F.row_number().over(own)
    return rows.withColumn("anchor", F.when(n > 1, F.concat(F.col("slug"), F.lit("-"), n.cast("string"))).otherwise(F.col("slug"))).select("path", "position", "level", "title", "anchor")
