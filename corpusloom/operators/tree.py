"""Folder trees from path lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, parent


def file_tree(paths: DataFrame) -> DataFrame:
    """One row per folder and file: path, name, parent, kind, depth; folders before files of a parent, then by name."""
    clean = paths.select(F.array_join(F.filter(F.split("path", "/"), lambda x: x != ""), "/").alias("path")).where("path <> ''").distinct()
    folders = clean.select(F.explode(ancestors("path")).alias("path")).distinct().withColumn("kind", F.lit("folder"))
    rows = folders.unionByName(clean.withColumn("kind", F.lit("file")))
    return rows.select("path", base_name("path").alias("name"), parent("path").alias("parent"), "kind", F.size(F.split("path", "/")).alias("depth")).orderBy("parent", F.desc("kind"), "name")


ROOT = "__root__"


def structure_graph(paths: DataFrame, project: str, expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tree as far as its folders are expanded (column path)."""
    tree = file_tree(paths).drop("depth")
    # a node shows if every folder above it is expanded
    above = tree.select("path", F.explode(ancestors("path")).alias("folder"))
    shut = above.join(expanded.select(F.col("path").alias("folder")).distinct(), "folder", "left_anti").select("path").distinct()
    shown = tree.join(shut, "path", "left_anti")
    ident = F.concat(F.col("kind"), F.lit(":"), F.col("path"))
    above_id = F.concat(F.lit("folder:"), F.when(F.col("parent") == "", F.lit(ROOT)).otherwise(F.col("parent")))
    root = paths.sparkSession.createDataFrame([(f"folder:{ROOT}", project, "project", "")], "id string, label string, kind string, path string")
    nodes = root.unionByName(shown.select(ident.alias("id"), F.col("name").alias("label"), "kind", "path"))
    edges = shown.select(F.concat(above_id, F.lit("->"), ident).alias("id"), above_id.alias("source"), ident.alias("target"), F.lit("contains").alias("label"))
    return nodes, edges
