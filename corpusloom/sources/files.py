"""File trees as tables, and text sinks."""

from __future__ import annotations

import contextlib
import functools
import itertools
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import normalize
from ..functions.text import redact_secrets
from ..operators.filters import is_indexable, is_searchable
from .page_files import export_pages  # noqa: F401
from .tables import work_path, written  # noqa: F401


#: What a file that is not UTF-8 is reported with (fixed value).
NOT_TEXT = "stream did not contain valid UTF-8"


def decode(files: DataFrame, column: str = "content") -> DataFrame:
    """The files with their bytes as text, null where these are not UTF-8, and error, null where they are."""
    text = F.col(column).cast("string")
    fits = F.is_valid_utf8(text)
    error = F.when(~fits, F.concat("path", F.lit(f": {NOT_TEXT}")))
    return files.withColumn("error", error).withColumn(column, F.when(fits, text))


def at_or_below(path: Column, top: str) -> Column:
    """Whether a path is top or lies below it."""
    return (path == top) | F.startswith(path, F.lit(top + "/"))


#: Entries that a task lists before it hands the folders below on to other tasks, and rows of an Arrow batch.
TASK_ENTRIES, BATCH_ROWS = 20_000, 8192
#: Content of an Arrow batch; a longer file is one of its own.
BATCH_BYTES = 4 << 20
#: Files of a task: at least as many before there is a further task, and at most.
LEAST_FILES, MOST_FILES = 64, 50_000


def _entries(base: str, folder: str, most: int):
    """(path, whether it is a folder) of what lies in a folder and, up to most entries, below it; a folder that is given out is not listed yet.

    Hidden names are passed over, and what is neither a file nor a folder, and names that are not UTF-8.
    """
    todo, seen = [folder], 0
    while todo:
        top = todo.pop()
        if seen >= most:
            yield top, True
            continue
        with os.scandir(os.path.join(base, top)) as found:
            for e in found:
                seen += 1
                path = f"{top}/{e.name}" if top else e.name
                if e.name.startswith(".") or any("\udc80" <= c <= "\udcff" for c in e.name):
                    continue
                if e.is_file():
                    yield path, False
                elif e.is_dir() and not (e.is_symlink() and _holds(e.path, os.path.join(base, top))):
                    todo.append(path)


def _holds(link: str, folder: str) -> bool:
    """Whether a link leads back to a folder or above it, so that following it would not end."""
    return os.path.join(os.path.realpath(folder), "").startswith(os.path.join(os.path.realpath(link), ""))


def _lister(base: str, most: int):
    def run(batches):
        for batch in batches:
            entries = (e for folder in batch.column(0).to_pylist() for e in _entries(base, folder, most))
            while rows := list(itertools.islice(entries, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "folder"])

    return run


def _dealt(rows: DataFrame, n: int, least: int = LEAST_FILES) -> DataFrame:
    """n rows of paths, dealt out to tasks by hash."""
    most = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // MOST_FILES))
    return rows.repartition(max(1, min(-(-n // least), most)), "path")


def listed_files(spark: SparkSession, base: str, top: str = "") -> tuple[DataFrame, int]:
    """path (relative to base) of each file at or below top, and how many: listed by tasks, so the driver holds none of them."""
    if any(not p or p.startswith(".") for p in top.split("/")) and top:
        return spark.createDataFrame([], "path string"), 0
    if top and not os.path.isdir(os.path.join(base, top)):
        found = [(top,)] if os.path.isfile(os.path.join(base, top)) else []
        return spark.createDataFrame(found, "path string"), len(found)
    folders, left, passes, n = spark.createDataFrame([(top,)], "path string"), 1, [], 0
    while left:
        seen = written(_dealt(folders, left, 1).mapInArrow(_lister(base, TASK_ENTRIES), "path string, folder boolean"), "listing")
        counts = {r["folder"]: r["count"] for r in seen.groupBy("folder").count().collect()}
        passes.append(seen.where("not folder").select("path"))
        n, left, folders = n + counts.get(False, 0), counts.get(True, 0), seen.where("folder").select("path")
    return functools.reduce(DataFrame.unionByName, passes), n


def _reader(base: str, most: int):
    kinds = {"path": pa.string(), "size_bytes": pa.int64(), "modified_at": pa.string(), "content": pa.binary()}

    def run(batches):
        rows, held = [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with open(os.path.join(base, path), "rb") as f:
                state = os.fstat(f.fileno())
                if state.st_size > most:
                    raise ValueError(f"{path} has {state.st_size} bytes, the max length is {most}")
                content = f.read()
            if rows and (held + len(content) > BATCH_BYTES or len(rows) >= BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
                rows, held = [], 0
            rows.append((path, len(content), str(state.st_mtime_ns // 1_000_000), content))
            held += len(content)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    return run


def scan_tree(spark: SparkSession, root: str, keep=is_indexable, below: str | None = None) -> DataFrame:
    """A scan of a tree: path (relative), size_bytes, modified_at (epoch millis as text), content (bytes); kept paths only.

    Paths are listed at once, by tasks, and filtered before they are dealt out: content is read of kept files only, where
    it is asked for.  Hidden files and folders are not seen; a file longer than Spark's limit for binary files is an error.
    """
    base = root.removeprefix("file://").rstrip("/") or "/"
    paths, n = listed_files(spark, base, below or "")
    wanted = keep(F.col("path")) & at_or_below(F.col("path"), below) if below else keep(F.col("path"))
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return _dealt(paths.where(wanted), n).mapInArrow(_reader(base, most), "path string, size_bytes long, modified_at string, content binary")


def delete_files(spark: SparkSession, root: str) -> int:
    """Deletes the files of a tree, but not its hidden ones, by tasks; returns how many there were."""
    base = root.removeprefix("file://").rstrip("/")
    paths, n = listed_files(spark, base)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):  # a task that runs again
                    os.remove(os.path.join(base, path))
            yield batch

    return _dealt(paths, n).mapInArrow(run, "path string").count()


def written_scan(files: DataFrame) -> DataFrame:
    """A scan of a tree, read once and written."""
    return written(files, "scan")


def search_tree(spark: SparkSession, root: str) -> DataFrame:
    return scan_tree(spark, root, is_searchable)


def inside(path, root: str) -> Column:
    """Whether a path, resolved, stays below root."""
    p = normalize(path, root)
    return (p != "") & ~F.startswith(p, F.lit("..")) & ~(F.startswith(path if isinstance(path, Column) else F.col(path), F.lit("/")) & ~F.startswith(path if isinstance(path, Column) else F.col(path), F.lit(root.rstrip("/") + "/")))


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as one Parquet table of (file_name, markdown), replaced as a whole."""
    pages.select("file_name", "path", "markdown").write.mode("overwrite").parquet(path)


def read_page(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The page of a source path; no row if it has none."""
    return spark.read.parquet(path).where(F.col("path") == source)


def append_log(lines: DataFrame, path: str) -> None:
    """Appends (at, message) rows as text, secrets redacted."""
    lines.select(F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), redact_secrets("message"))).write.mode("append").text(path)


# Scores of folders that may be a project's root.
MARKERS = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "setup.py", "Gemfile", "pom.xml", "build.gradle", "build.gradle.kts")
SUSPICIOUS = ("output", "outputs", "report", "reports", "dist", "build", "target", "coverage", "tmp", "temp", "node_modules")
MOST_ANCESTORS, PROMOTION = 7, 40


def root_scores(folders: DataFrame) -> DataFrame:
    """folder, entries array<string> (names in it) to folder, score, git_only, suspicious."""
    leaf = F.lower(F.element_at(F.split("folder", "/"), -1))
    has = lambda name: F.array_contains("entries", name)
    marks = sum((F.when(has(m), 30).otherwise(0) for m in MARKERS), F.lit(0))
    any_mark = F.arrays_overlap("entries", F.array(*[F.lit(m) for m in MARKERS]))
    some = lambda c, x: F.when(c, x).otherwise(0)
    odd = leaf.isin(*SUSPICIOUS)
    score = some(odd, -25) + some(leaf == "node_modules", -100) + some(has(".git"), 100) + marks + some(has("README.md"), 5)
    return folders.select("folder", score.alias("score"), (has(".git") & ~any_mark & ~has("README.md")).alias("git_only"), odd.alias("suspicious"))


def resolve_root(folders: DataFrame, selected: str, home: str | None = None) -> str:
    """The project root for a selected folder: its best ancestor, if that is clearly better."""
    parts = selected.rstrip("/").split("/")
    chain = ["/".join(parts[: len(parts) - i]) or "/" for i in range(min(MOST_ANCESTORS, len(parts)))]
    if home in chain:
        chain = chain[: chain.index(home)]
    known = {r["folder"]: r for r in root_scores(folders.where(F.col("folder").isin(*chain, selected))).collect()}
    own = known.get(selected)
    best = max((known[c] for c in chain if c in known), key=lambda r: (r["score"], len(r["folder"])), default=None)
    if own is None or best is None or best["folder"] == selected or best["git_only"]:
        return selected
    return best["folder"] if best["score"] >= own["score"] + PROMOTION or (own["suspicious"] and best["score"] > own["score"]) else selected
