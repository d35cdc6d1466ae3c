"""Stateful stream operators: replay removal, conflict detection, outcome join, alarms."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memspark import vocab as v

TTL = f"{v.IDEMPOTENCY_TTL_HOURS} hours"


def without_replays(requests: DataFrame, keys: tuple[str, ...] = ("tenant_id", "key", "verb"), ts: str = "at", ttl: str = TTL) -> DataFrame:
    """The first request of every key inside the retention time."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(list(keys))


def classified(requests: DataFrame, ttl_hours: int = v.IDEMPOTENCY_TTL_HOURS, delay: str | None = None) -> DataFrame:
    """Adds ``outcome`` (fresh, replay, conflict) to a stream ``(tenant_id, key, verb, body_hash, at, seq)``.

    The state of a key is the hash and time of its last fresh request.  A request after the
    retention time is fresh again.  A request up to ``delay`` (the retention time unless given) older than
    the newest one seen is answered like any other; what comes later than that Spark leaves out and counts
    (``numRowsDroppedByWatermark`` of the query's progress).  State is dropped when the watermark has passed
    the retention time.  Requests of one micro-batch are taken in the order of (at, seq).
    """
    ttl_us = ttl_hours * 3_600_000_000
    out = T.StructType([*requests.schema.fields, T.StructField("outcome", T.StringType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        for rows in batches:
            if len(rows) > 1:  # most keys have one request, for which sorting costs more than all else
                rows = rows.sort_values(["at", "seq"])
            outcomes = []
            for at, body in zip(_micros(rows["at"]), rows["body_hash"].tolist()):
                if held is None or at >= held[1] + ttl_us:
                    held = (body, at)
                    outcomes.append("fresh")
                else:
                    outcomes.append("replay" if held[0] == body else "conflict")
            rows["outcome"] = outcomes
            yield rows
        if held is not None:
            state.update(held)
            state.setTimeoutTimestamp(max((held[1] + ttl_us) // 1000, state.getCurrentWatermarkMs() + 1))

    return (
        requests.withWatermark("at", delay or f"{ttl_hours} hours").groupBy("tenant_id", "key", "verb")
        .applyInPandasWithState(step, out, "body_hash string, at_us bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def _micros(ts: pd.Series) -> list[int]:
    """Microseconds since 1970 as plain numbers."""
    return (ts.to_numpy(dtype="datetime64[us]").astype("int64")).tolist()


def join_outcomes(recalls: DataFrame, outcomes: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Recalls with their outcomes; one without any is emitted as ``no_op`` once the time is over.

    Both sides must come from their own stream reader.
    """
    r = recalls.withWatermark("ts", delay)
    o = outcomes.select(F.col("recall_id").alias("_id"), "outcome", F.col("ts").alias("outcome_ts")).withWatermark("outcome_ts", delay)
    cond = F.expr(f"recall_id = _id AND outcome_ts >= ts AND outcome_ts <= ts + INTERVAL {within}")
    return r.join(o, cond, "leftOuter").withColumn("outcome", F.coalesce("outcome", F.lit("no_op"))).drop("_id")


def windowed_counts(events: DataFrame, keys: tuple[str, ...], ts: str, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(keys…, window_start, n): sliding counts for rate and alarm rules."""
    w = F.window(ts, window, slide or window)
    return (
        events.withWatermark(ts, delay).groupBy(*keys, w.alias("_w")).agg(F.count("*").alias("n"))
        .select(*keys, F.col("_w.start").alias("window_start"), "n")
    )


def alarms(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit)


def decayed_utility(events: DataFrame, days: int = 30, slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sliding approximation of the utility sum: decay is measured at the end of each window."""
    from memspark.functions.common import days_between
    from memspark.operators.utility import event_weight

    w = F.window("ts", f"{days} days", slide)
    rows = events.withWatermark("ts", delay).select("tenant_id", "fact_id", "event_kind", "ts", w.alias("_w"))
    term = event_weight(F.col("event_kind")) * F.exp(-days_between(F.col("_w.end"), F.col("ts")) / F.lit(float(days)))
    return rows.groupBy("tenant_id", "fact_id", "_w").agg(F.sum(term).alias("utility_raw")).select(
        "tenant_id", "fact_id", F.col("_w.end").alias("window_end"), "utility_raw"
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run the stream over what is there, into parquet."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def forward_decay(events: DataFrame, landmark: str, tau_days: float = v.UTILITY_TAU_DAYS, keys: tuple[str, ...] = ("tenant_id", "fact_id")) -> DataFrame:
    """(keys…, forward_sum): weights that grow from a fixed ``landmark`` on instead of decaying towards now.

    The sum of a key is one number that partial sums add up to, so the state of the stream is one row per key, rows of any
    age count in full, and no watermark leaves any out.  ``decayed_at`` turns sums into utilities at any time.
    Sums stay within a double for some 700 times ``tau_days`` behind the landmark.
    """
    from memspark.functions.common import days_between
    from memspark.operators.utility import event_weight

    grown = F.exp(days_between(F.col("ts"), F.to_timestamp(F.lit(landmark))) / F.lit(float(tau_days)))
    return events.groupBy(*keys).agg(F.sum(event_weight(F.col("event_kind")) * grown).alias("forward_sum"))


def decayed_at(sums: DataFrame, landmark: str, at: Column, tau_days: float = v.UTILITY_TAU_DAYS) -> DataFrame:
    """``utility_raw`` of forward sums at a time not before their last event."""
    from memspark.functions.common import days_between

    return sums.withColumn("utility_raw", F.col("forward_sum") * F.exp(-days_between(at, F.to_timestamp(F.lit(landmark))) / F.lit(float(tau_days)))).drop("forward_sum")


def latest_sums(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that a batch changed to a folder of its own; a batch that runs again replaces it."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sums.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
