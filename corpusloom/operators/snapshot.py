"""Snapshots of a file set, change detection, upserts and run roll-ups.

Tables are rewritten as new snapshots (rows of the batch, then old rows that the
batch does not name), which is how plain Parquet takes upserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language
from .filters import is_graph_source
from .scans import running_totals

FILE_COLUMNS = ["path", "workspace_root", "language", "size_bytes", "modified_at", "content_hash", "last_indexed_at", "status"]


def describe_files(files: DataFrame, root: str = "") -> DataFrame:
    """path, content (binary or string)[, modified_at] to the columns of a scanned file."""
    content = F.col("content").cast("binary")
    modified = F.col("modified_at") if "modified_at" in files.columns else F.lit(None)
    return files.select(
        "path",
        F.lit(root).alias("workspace_root"),
        language("path").alias("language"),
        F.octet_length(content).cast("long").alias("size_bytes"),
        modified.cast("string").alias("modified_at"),
        F.sha2(content, 256).alias("content_hash"),
    )


def classify(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per path of either side: path, status (new, changed, unchanged, deleted), old and new hash.

    A path that is stored as deleted and is scanned again counts as new.
    """
    s = scanned.select("path", F.col("content_hash").alias("new_hash"))
    t = stored.select("path", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"))
    both = s.join(t, "path", "full_outer")
    status = (
        F.when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull() | (F.col("old_status") == "deleted"), "new")
        .when(F.col("new_hash") != F.col("old_hash"), "changed")
        .otherwise("unchanged")
    )
    return both.select("path", status.alias("status"), "old_hash", "new_hash")


def deleted_paths(tracked: DataFrame, discovered: DataFrame) -> DataFrame:
    """Tracked paths that are no more there."""
    return tracked.where("status <> 'deleted'").select("path").join(discovered.select("path"), "path", "left_anti")


def tracked_files(files: DataFrame, root: str, prefix: str | None = None) -> DataFrame:
    """Paths that are not deleted, of a root, below a prefix (whose _ and % match as in LIKE, whatever the case)."""
    rows = files.where((F.col("status") != "deleted") & (F.col("workspace_root") == root))
    if prefix:
        rows = rows.where((F.col("path") == prefix) | F.col("path").ilike(f"{prefix}/%"))
    return rows.select("path").orderBy("path")


def upsert(table: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """The table after inserting the batch, whose rows replace those of equal keys."""
    return batch.select(*table.columns).unionByName(table.join(batch.select(*keys).distinct(), keys, "left_anti"))


def replace_by(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Deletes all rows of the batch's keys, then inserts the batch."""
    return upsert(table, batch, [key])


def mark_deleted(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Tombstones: status of the named paths becomes deleted; rows stay."""
    gone = paths.select("path").distinct().withColumn("_gone", F.lit(True))
    return table.join(gone, "path", "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).select(*table.columns)


def mark_indexed(table: DataFrame, paths: DataFrame, now: str) -> DataFrame:
    """Status unchanged and the time of indexing for the named paths; tombstones stay."""
    done = paths.select("path").distinct().withColumn("_done", F.lit(True))
    hit = F.col("_done") & (F.col("status") != "deleted")
    return (
        table.join(done, "path", "left")
        .withColumn("last_indexed_at", F.when(hit, F.lit(now)).otherwise(F.col("last_indexed_at")))
        .withColumn("status", F.when(hit, "unchanged").otherwise(F.col("status")))
        .select(*table.columns)
    )


def ensure_column(table: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """Additive migration: the table with the column, filled where it was missing."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(kind))


def file_actions(changes: DataFrame, graph_paths: DataFrame) -> DataFrame:
    """What indexing does with each path: (path, status, skipped, parse).

    Files of no parsed language are recorded but skipped; an unchanged file
    that the graph does not know is parsed again.
    """
    known = graph_paths.select("path").distinct().withColumn("_known", F.lit(True))
    rows = changes.join(known, "path", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    source = is_graph_source("path")
    gone, same = F.col("status") == "deleted", F.col("status") == "unchanged"
    skipped = F.when(gone, False).when(~source, True).otherwise(same & F.col("_known"))
    return rows.select("path", "status", skipped.alias("skipped"), (source & ~gone & ~(same & F.col("_known"))).alias("parse"))


def run_summary(actions: DataFrame) -> DataFrame:
    """One row: files seen, changed, skipped, deleted, errors and the run's status."""
    error = F.col("error").isNotNull() if "error" in actions.columns else F.lit(False)
    moved = ~F.col("skipped") & ~error
    return actions.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(moved).alias("files_changed"),
        F.count_if(F.col("skipped") & ~error).alias("files_skipped"),
        F.count_if(moved & (F.col("status") == "deleted")).alias("files_deleted"),
        F.count_if(error).alias("errors"),
        F.when(F.count_if(error) == 0, "complete").otherwise("error").alias("run_status"),
    )


def progress(actions: DataFrame, group: str | None = None) -> DataFrame:
    """Running counters in path order, one row per file; with group, of each group on its own.  Spread over range partitions."""
    moved = ~F.col("skipped")
    flag = lambda c: F.when(c, 1).otherwise(0)
    counters = {"files_seen": F.lit(1), "files_changed": flag(moved), "files_skipped": flag(F.col("skipped")), "files_deleted": flag(moved & (F.col("status") == "deleted"))}
    return running_totals(actions, ["path"], counters, group)


def begin_run(runs: DataFrame, started_at: str) -> DataFrame:
    """The runs with one more, whose id is the greatest plus one."""
    new = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")).select(
        "id", F.lit(started_at).alias("started_at"), F.lit(None).cast("string").alias("finished_at"), F.lit(0).cast("long").alias("files_seen"), F.lit(0).cast("long").alias("files_changed"), F.lit("running").alias("status")
    )
    return runs.unionByName(new)


def finish_run(runs: DataFrame, run_id: int, finished_at: str, files_seen: int, files_changed: int, status: str) -> DataFrame:
    own = F.col("id") == run_id
    new = {"finished_at": finished_at, "files_seen": files_seen, "files_changed": files_changed, "status": status}
    return runs.select(*[F.when(own, F.lit(new[c])).otherwise(F.col(c)).cast(runs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in runs.columns])


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1)


def cascade(children: DataFrame, parents: DataFrame, key: str = "path") -> DataFrame:
    """The rows whose parent still exists: what a foreign key with cascading deletes leaves."""
    return children.join(parents.select(key).distinct(), key, "left_semi")
