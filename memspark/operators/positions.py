"""Places and running sums in sorted groups of any size.

A window over a group puts the whole group in one task.  Here rows are sorted into ranges over all
groups, sized by row counts, so a group with a third of all rows lies in a third of the tasks.
Each range is summed up on its own and the sums of the ranges before it are joined back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.session import broadcast_if, checkpointed

BROADCAST_ROWS = 200_000  # rows of the table of ranges (one for each group and range) that are sent to every task


def ranges(rows: DataFrame, by: tuple[str, ...], order: list[Column], n_ranges: int | None = None) -> DataFrame:
    """``rows`` sorted by group and order, with ``_part`` (range) and ``_row`` (number, ascending within a range).

    The result is a reliable checkpoint: numbers are stored, no later scan derives them anew.
    """
    keys = [*(F.asc_nulls_first(c) for c in by), *order]
    spread = rows.repartitionByRange(n_ranges, *keys) if n_ranges else rows.repartitionByRange(*keys)
    return checkpointed(
        spread.sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    )


def positions(rows: DataFrame, by: tuple[str, ...], order: list[Column], n_ranges: int | None = None) -> DataFrame:
    """``rows`` with ``pos``, the place of each row in its group (from 0), and ``n``, the size of the group.

    Equal rows have places in no defined order.  Null group values are a group like any other.
    """
    placed = ranges(rows, by, order, n_ranges)
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_here"), F.min("_row").alias("_first"))
    table = _before(counts, by, "_here").withColumn("_shift", F.col("_before") - F.col("_first"))
    found = _attach(placed, table.select(*by, "_part", "_shift", F.col("_total").alias("n")), by)
    return found.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def running_sum(rows: DataFrame, value: str, by: tuple[str, ...], order: list[Column], name: str = "before", n_ranges: int | None = None, total: str | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of the group in front of each one, and with ``total``, that of the whole group.

    The windows inside cover one group within one range, which has a bounded number of rows.
    """
    placed = ranges(rows, by, order, n_ranges)
    sums = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_here"))
    table = _before(sums, by, "_here").select(*by, "_part", "_before", *([F.col("_total").alias(total)] if total else []))
    inner = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    found = _attach(placed.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))), table, by)
    return found.withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_row", "_inner", "_before")


def _before(parts: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Sums over the earlier ranges of a group and over all of them; one row for each group and range."""
    own = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(value).over(earlier), F.lit(0))).withColumn("_total", F.sum(value).over(own))


def _attach(rows: DataFrame, table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Join on group and range; null groups meet too."""
    renamed = table.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), *(c for c in table.columns if c not in by and c != "_part"))
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(broadcast_if(renamed, BROADCAST_ROWS), on).drop("_p", *(f"_k{i}" for i in range(len(by))))
