"""Scans in a total order, spread over range partitions.

Rows are range-partitioned by (group, order), sorted and written once, so a group
of any size lies in as many partitions as it fills.  Each partition is scanned on
its own; what a scan needs from before it (totals, or the last row) is one row for
each partition and group, which a second pass adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

_PART_BITS = 33


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows, written in order, with _part (range partition) and _place (row in it); ties fall where the sort puts them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    done = done.withColumns({"_part": F.shiftright("_at", _PART_BITS), "_place": F.col("_at").bitwiseAND((1 << _PART_BITS) - 1)})
    return written(done.drop("_at"), "placed")


def _own() -> Window:
    return Window.partitionBy("_part", "_group").orderBy("_place")


def _ahead() -> Window:
    return Window.partitionBy("_group").orderBy("_part")


def running_totals(rows: DataFrame, order: list[str], counters: dict[str, Column], group: str | None = None) -> DataFrame:
    """rows with running sums of counters (long) in the given order; with group, of each group on its own."""
    held = placed(rows.withColumns({"_group": F.col(group) if group else F.lit(0), **{f"_{n}": c.cast("long") for n, c in counters.items()}}), "_group", *order)
    totals = held.groupBy("_part", "_group").agg(*[F.sum(f"_{n}").alias(n) for n in counters])
    before = _ahead().rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.col("_group").alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in counters])
    own = held.withColumns({f"_{n}": F.sum(f"_{n}").over(_own().rowsBetween(Window.unboundedPreceding, 0)) for n in counters})
    both = own.join(offsets.withColumnRenamed("_part", "_of_part"), (F.col("_part") == F.col("_of_part")) & F.col("_group").eqNullSafe(F.col("_of")))
    return both.select(*rows.columns, *[(F.col(f"_{n}") + F.col(f"_before_{n}")).alias(n) for n in counters])


def without_adjacent_repeats(rows: DataFrame, order: list[str], key: list[str], group: str | None = None) -> DataFrame:
    """Rows in order without those whose key equals that of the row before; with group, in each group on its own."""
    held = placed(rows.withColumn("_group", F.col(group) if group else F.lit(0)), "_group", *order).withColumn("_key", F.struct(*key))
    lasts = held.groupBy("_part", "_group").agg(F.max_by("_key", "_place").alias("_last"))
    handed = lasts.select(F.col("_part").alias("_of_part"), F.col("_group").alias("_of"), F.lag("_last").over(_ahead()).alias("_handed"), (F.row_number().over(_ahead()) == 1).alias("_none"))
    own = held.withColumns({"_before": F.lag("_key").over(_own()), "_first": F.row_number().over(_own()) == 1})
    both = own.join(handed, (F.col("_part") == F.col("_of_part")) & F.col("_group").eqNullSafe(F.col("_of")))
    same = F.when(F.col("_first"), ~F.col("_none") & F.col("_key").eqNullSafe(F.col("_handed"))).otherwise(F.col("_key").eqNullSafe(F.col("_before")))
    return both.where(~same).select(*rows.columns)
