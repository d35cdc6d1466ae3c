"""Always-loaded preference pages, packed newest first under a byte cap."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import fail_when


def preference_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("kind").isin("preference", "prohibition"))


def pack(pages: DataFrame, cap_bytes: int = v.PREFERENCES_CAP_BYTES, group: str = "tenant_id") -> DataFrame:
    """Pages kept per tenant: the longest newest-first prefix whose bytes fit the cap.

    Everything behind the first page that does not fit is dropped, also smaller pages.  Bytes are
    summed per tenant and day, then per minute of the day in which the cap is passed; only the pages of the
    minute in which it is passed are ordered, however many pages a tenant has.
    """
    if cap_bytes <= 0:
        raise ValueError("cap_bytes must be positive")
    size = fail_when(F.col("bytes") < 0, F.concat(F.lit("negative bytes: "), F.col("page_uri")), F.col("bytes"))
    rows = pages.withColumn("bytes", size)
    head = rows.where(F.col("bytes") > 0).select(group, "revised_at", "page_uri", "bytes", F.lit(0).cast("bigint").alias("_before"))
    for unit in ("day", "minute"):
        head = head.withColumn("_slot", F.date_trunc(unit, "revised_at"))
        slots = head.groupBy(group, "_slot").agg(F.sum("bytes").alias("_b"), F.first("_before").alias("_0"))
        later = Window.partitionBy(group).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, 0)
        slots = slots.withColumn("_up", F.col("_0") + F.sum("_b").over(later))
        passed = slots.where((F.col("_up") > cap_bytes) & (F.col("_up") - F.col("_b") <= cap_bytes))
        passed = passed.select(group, F.col("_slot").alias("_at"), (F.col("_up") - F.col("_b")).alias("_new"))
        head = head.join(passed, group).where(F.col("_slot").eqNullSafe(F.col("_at")))
        head = head.select(group, "revised_at", "page_uri", "bytes", F.col("_new").alias("_before"))
    newest = Window.partitionBy(group).orderBy(F.desc("revised_at"), F.desc("page_uri")).rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("_run", F.col("_before") + F.sum("bytes").over(newest))
    overflow = head.where(F.col("_run") > cap_bytes).groupBy(group).agg(
        F.max(F.struct("revised_at", "page_uri")).alias("_stop")
    )
    kept = rows.join(overflow, group, "left").where(
        F.col("_stop").isNull() | (F.struct("revised_at", "page_uri") > F.col("_stop"))
    )
    return kept.drop("_stop")


def envelope(pages: DataFrame, cap_bytes: int = v.PREFERENCES_CAP_BYTES, group: str = "tenant_id") -> DataFrame:
    """(tenant, n_pages, total_bytes, truncated) per tenant with pages."""
    kept = pack(pages, cap_bytes, group).groupBy(group).agg(
        F.count("*").alias("n_pages"), F.sum("bytes").alias("total_bytes")
    )
    return pages.groupBy(group).agg(F.count("*").alias("_all")).join(kept, group, "left").select(
        group, F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        (F.col("_all") > F.coalesce("n_pages", F.lit(0))).alias("truncated"),
    )
