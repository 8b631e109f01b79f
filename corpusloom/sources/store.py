"""Tables cut into buckets of their key, and commits that name the version of every bucket.

A table's rows lie in ``<folder>/<table>/<version>/bucket=<b>``, the bucket being a
hash of its key.  A change writes new versions of the buckets it touches and
leaves the others as they are.  What is valid is said by one small file, the last
of ``_commits``: for each table, which version each bucket has.  A commit covers
any number of tables and takes effect when its file gets its name, which fails
where another writer was first; until then, and after any failure, readers see the
tables as they were.  Versions that the last KEPT commits do not name are deleted.

The folder may be on any file system that Spark's Hadoop client reaches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits whose versions stay, for readers that began before the last one.
KEPT = 3
BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit came first."""


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Tables:
    """schemas: DDL by table; keys: the column by which a table is cut into buckets (else it is one bucket, 0)."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schemas, self.keys, self.buckets = spark, folder.rstrip("/"), schemas, keys or {}, buckets

    # --- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._files().listStatus(path)) if self._files().exists(path) else []

    def _load(self, name: str) -> dict:
        stream = self._files().open(self._path("_commits", name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commits(self) -> list[str]:
        return [n for n in self._names("_commits") if n.endswith(".json")]

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """(number of the last commit, version by bucket by table); buckets without rows are not named."""
        names = self._commits()
        return (int(names[-1].removesuffix(".json")), self._load(names[-1])) if names else (0, {})

    # --- reading

    def read(self, name: str, buckets: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, as of the last commit (or the given one)."""
        held = (self.manifest()[1] if manifest is None else manifest).get(name, {})
        paths = [f"{self.folder}/{name}/{version}/bucket={b}" for b, version in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    # --- writing

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows as a new version; returns it for each bucket that has rows."""
        version, key = uuid.uuid4().hex, self.keys.get(name)
        columns = self.spark.createDataFrame([], self.schemas[name]).schema
        rows = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns])
        rows = rows.withColumn("bucket", bucket_of(key, self.buckets) if key else F.lit(0))
        if key:
            rows = rows.hint("rebalance", "bucket")  # few files a bucket; a large bucket is split
        rows.write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{version}")
        return {n.removeprefix("bucket="): version for n in self._names(name, version) if n.startswith("bucket=")}

    def folder_of(self, name: str) -> str | None:
        """The folder that the last commit names for a thing that is no table of rows (an index)."""
        held = self.manifest()[1].get(name)
        return f"{self.folder}/{name}/{held['']}" if held else None

    def new_folder(self, name: str) -> str:
        """Where to write a new version of such a thing, whose last part commit() takes."""
        return f"{self.folder}/{name}/{uuid.uuid4().hex}"

    def commit(self, whole: dict[str, DataFrame] | None = None, merged: dict[str, tuple[DataFrame, DataFrame]] | None = None, folders: dict[str, str | None] | None = None) -> int:
        """One commit: whole tables replaced, tables merged as (batch, gone), and folders named (None: no more).

        A merge deletes the rows whose key is in gone (a column named like the table's key) and adds the batch, whose keys
        should be among gone; only buckets of either are written again.  Returns the commit's number.
        """
        number, now = self.manifest()
        new = dict(now)
        for name, rows in (whole or {}).items():
            new[name] = self._write(name, rows)
        for name, (batch, gone) in (merged or {}).items():
            key = self.keys[name]
            gone = gone.select(key).distinct()
            found = gone.select(bucket_of(key, self.buckets).alias("b")).unionByName(batch.select(bucket_of(key, self.buckets).alias("b"))).distinct()
            touched = {r["b"] for r in found.collect()}  # at most as many as there are buckets
            if not touched:
                continue
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            rows = self.read(name, touched, now).join(gone, key, "left_anti").select(*columns).unionByName(batch.select(*columns))
            written = self._write(name, rows)
            new[name] = {b: v for b, v in now.get(name, {}).items() if int(b) not in touched} | written
        for name, path in (folders or {}).items():
            new[name] = {"": path.rsplit("/", 1)[-1]} if path else {}
        self._publish(number + 1, new)
        self._sweep()
        return number + 1

    def _publish(self, number: int, manifest: dict) -> None:
        files, options = self._files(), self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        draft, final = self._path("_commits", f"{uuid.uuid4().hex}.draft"), self._path("_commits", f"{number:012d}.json")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        kinds = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(kinds, 1)
        array[0] = options
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, array)  # fails where the name is taken
        except Exception as e:
            files.delete(draft, False)
            if files.exists(final):
                raise Conflict(f"commit {number} was made by another writer") from e
            raise

    def _sweep(self) -> None:
        """Deletes old commits, and versions that no kept commit names."""
        names, files = self._commits(), self._files()
        kept = [self._load(n) for n in names[-KEPT:]]
        for n in names[:-KEPT]:
            gone = self._load(n)
            for table, held in gone.items():
                for version in set(held.values()) - {v for k in kept for v in k.get(table, {}).values()}:
                    files.delete(self._path(table, version), True)
                for b, version in held.items():
                    if version not in {k.get(table, {}).get(b) for k in kept}:
                        files.delete(self._path(table, version, f"bucket={b}"), True)
            files.delete(self._path("_commits", n), False)

    def remove_orphans(self) -> int:
        """Deletes versions that no kept commit names, as failed writes leave them; not to be run beside a writer.  Returns how many."""
        kept, files, removed = [self._load(n) for n in self._commits()[-KEPT:]], self._files(), 0
        for table in self._names():
            named = {v for k in kept for v in k.get(table, {}).values()}
            for version in self._names(table) if table != "_commits" and table in {n for k in kept for n in k} | set(self.schemas) else []:
                if version not in named:
                    removed += files.delete(self._path(table, version), True)
        return removed
