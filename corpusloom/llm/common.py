"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Content of an Arrow batch between the JVM and a Python worker; an executor's workers hold a few at a time.
ARROW_BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the actions inside; what was set before comes back."""
    held = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the write that needed them is done.
NO_SHUFFLE_LEFT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def whole_numbers(df: DataFrame, *columns: str) -> None:
    """Raises where a column of ids is not of an integer type: such ids cannot be carried as whole numbers."""
    for c in columns:
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
            raise TypeError(f"ids must be whole numbers: {c} is {df.schema[c].dataType.simpleString()}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only a session with a local master, which names none, gets a temporary one; any other one raises, as its
    executors would write parts of a table to their own disks.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the application ends."""
    own = f"{shared_dir(spark)}/corpusloom-{spark.sparkContext.applicationId}"
    files, path = _path(spark, own)
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, once no plan that is still to run reads them; others go when the application ends."""
    for df in tables:
        files, path = _path(df.sparkSession, df.written_path)
        files.delete(path, True)


def bounded_join(left: DataFrame, right: DataFrame, on, most_rows: int, how: str = "inner") -> DataFrame:
    """Join with a written table: broadcast if it has at most most_rows rows, else by a shuffle, whose skewed partitions AQE splits."""
    few = right.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(right) if few else right, on, how)


#: Parts of a sort up to which the table of their offsets is broadcast (12 bytes each), and the bits of Spark's row ids that number a part's rows.
BROADCAST_PARTS, PART_BITS = 2_000_000, 33


def sort_and_number(rows: DataFrame, label: str, *order) -> tuple[DataFrame, DataFrame]:
    """rows, range-sorted and written with part and local (the place in the part), and (part, before): rows of the parts before."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    done = done.withColumn("part", F.shiftright("_at", PART_BITS).cast("int")).withColumn("local", F.col("_at").bitwiseAND((1 << PART_BITS) - 1)).drop("_at")
    held = materialize(done, label)
    before, total = [], 0
    for part, n in sorted(held.groupBy("part").count().collect()):  # as many rows as the sort has partitions
        before.append((part, total))
        total += n
    return held, spark.createDataFrame(before, "part int, before long")


def with_place(held: DataFrame, offsets: DataFrame) -> DataFrame:
    """The rows of sort_and_number with place, their number in the whole order, in place of part and local."""
    return bounded_join(held, offsets, "part", BROADCAST_PARTS).withColumn("place", F.col("before") + F.col("local")).drop("part", "before", "local")


def ascii_lower(col):
    """Lower-case A-Z only, as the contracts ask; other letters stay."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def arrow_batches(batches, most_bytes: int = 1 << 20):
    """Slice incoming record batches so that one slice holds about a MB (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * most_bytes / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
