"""The file/symbol graph: three tables (files, symbols, contains) and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels

SYMBOL_COLUMNS = ["path", "name", "kind", "parent", "source", "start_line", "start_column", "end_line", "end_column"]
# What an import's source may name, in order of trial.
IMPORT_FORMS = ("{}", "{}.ts", "{}.tsx", "{}.js", "src/{}", "src/{}.ts", "src/{}.tsx")


def with_ids(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("id", labels.symbol_id("path", "kind", "name", "start_line", "start_column"))


def graph_symbols(symbols: DataFrame) -> DataFrame:
    """Symbol nodes: one row per id, of equal ids the last in source order."""
    last = Window.partitionBy("id").orderBy(F.desc("end_line"), F.desc("end_column"), F.col("parent").desc_nulls_last(), F.col("source").desc_nulls_last())
    return with_ids(symbols).withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def contains(symbols: DataFrame) -> DataFrame:
    """Edges from a file to its symbols, each once."""
    return with_ids(symbols).select(F.col("path").alias("file_path"), F.col("id").alias("symbol_id")).distinct()


def replace_files(table: DataFrame, batch: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """A graph table after the files' rows were replaced by the batch's."""
    gone = files.select(F.col("path").alias(key)).distinct()
    return batch.select(*table.columns).unionByName(table.join(gone, key, "left_anti"))


def clear_files(table: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return table.join(files.select(F.col("path").alias(key)).distinct(), key, "left_anti")


def contains_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def symbols_of_file(symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    own = edges.where(F.col("file_path") == path)
    return symbols.join(own, F.col("id") == F.col("symbol_id")).orderBy("start_line", "start_column", "name").select(*SYMBOL_COLUMNS)


def symbols_by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).orderBy("path", "start_line", "start_column").select(*SYMBOL_COLUMNS)


def graph_context(symbols: DataFrame, edges: DataFrame, target: str, limit: int) -> DataFrame:
    """Symbols of the file of that path, then symbols of that name, at most limit together, in order."""
    limit = max(1, limit)
    inside = symbols_of_file(symbols, edges, target).limit(limit).select(F.lit(0).alias("branch"), F.lit("contains").alias("relation"), *SYMBOL_COLUMNS)
    named = symbols_by_name(symbols, target).limit(limit).select(F.lit(1).alias("branch"), F.lit("matches_symbol").alias("relation"), *SYMBOL_COLUMNS)
    first = F.when(F.col("branch") == 1, F.col("path"))
    return inside.unionByName(named).orderBy("branch", first, "start_line", "start_column", "name").limit(limit).drop("branch")


def graph_contexts(symbols: DataFrame, edges: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """graph_context for a table of targets: target, relation and the symbols' columns, at most limit rows a target."""
    limit = max(1, limit)
    inside = targets.join(edges, F.col("target") == F.col("file_path")).join(symbols, F.col("symbol_id") == F.col("id"))
    inside = inside.select("target", F.lit(0).alias("branch"), F.lit("contains").alias("relation"), *SYMBOL_COLUMNS)
    named = targets.join(symbols, F.col("target") == F.col("name")).select("target", F.lit(1).alias("branch"), F.lit("matches_symbol").alias("relation"), *SYMBOL_COLUMNS)
    first = Window.partitionBy("target").orderBy("branch", F.when(F.col("branch") == 1, F.col("path")), "start_line", "start_column", "name")
    return inside.unionByName(named).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= limit).drop("_rank", "branch")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, source) with target and local: the first form of the source that is a file, else lib::source."""
    forms = F.array(*[F.struct(F.lit(i).alias("rank"), F.format_string(f.replace("{}", "%s"), F.col("source")).alias("form")) for i, f in enumerate(IMPORT_FORMS)])
    tried = imports.select("id", "source", F.explode(forms).alias("f")).select("id", "source", "f.rank", "f.form")
    found = tried.join(files.select(F.col("path").alias("form")).distinct(), "form").groupBy("id", "source").agg(F.min_by("form", "rank").alias("found"))
    return imports.select("id", "source").distinct().join(found, ["id", "source"], "left").select("id", "source", F.coalesce("found", F.concat(F.lit("lib::"), "source")).alias("target"), F.col("found").isNotNull().alias("local"))


def graph_view(symbols: DataFrame, edges: DataFrame, files: DataFrame, path: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(nodes id, label, kind; edges id, source, target, label) around a file."""
    spark = symbols.sparkSession
    own = with_ids(symbols_of_file(symbols, edges, path).limit(max(1, limit)))
    imports = own.where("kind = 'import' and source is not null")
    targets = resolve_imports(imports.select("id", "source"), files)
    file_node = spark.createDataFrame([(path, path, "file", 0)], "id string, label string, kind string, rank int")
    symbol_nodes = own.select("id", F.col("name").alias("label"), labels.visual_kind("kind", "name").alias("kind"), F.lit(1).alias("rank"))
    target_nodes = targets.select(
        F.col("target").alias("id"), F.when(F.col("local"), F.col("target")).otherwise(F.col("source")).alias("label"), F.when(F.col("local"), "file").otherwise("external_library").alias("kind"), F.lit(2).alias("rank")
    )
    first = Window.partitionBy("id").orderBy("rank", "label")
    nodes = file_node.unionByName(symbol_nodes).unionByName(target_nodes).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("id", "label", "kind")
    link = lambda source, target, label: (F.concat(source, F.lit("->"), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(label).alias("label"))
    inside = own.select(*link(F.lit(path), F.col("id"), "contains"))
    imported = imports.select("id", "source").join(targets, ["id", "source"]).select(*link(F.col("id"), F.col("target"), "imports"))
    return nodes, inside.unionByName(imported)


def legend(nodes: DataFrame) -> DataFrame:
    """kind, label, color of the kinds that nodes have, in a fixed order, one row per label and color."""
    spark = nodes.sparkSession
    known = spark.createDataFrame([(i, *row) for i, row in enumerate(labels.LEGEND)], "rank int, kind string, label string, color string")
    have = nodes.where("kind <> 'file'").select("kind").distinct()
    return known.join(have, "kind", "left_semi").groupBy("label", "color").agg(F.min_by("kind", "rank").alias("kind"), F.min("rank").alias("rank")).orderBy("rank").select("rank", "kind", "label", "color")


def context_summary(contexts: DataFrame) -> DataFrame:
    """dependents, exports and complexity of a graph context."""
    return contexts.agg(F.count(F.lit(1)).alias("dependents"), F.count_if(F.contains(F.lower("relation"), F.lit("contains"))).alias("exports")).withColumn("complexity", labels.complexity("dependents"))
