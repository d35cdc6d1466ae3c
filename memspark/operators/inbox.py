"""Peer messages: cap, expiry, status."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.text import sensitive
from memspark.session import union_all

TYPES = ("query", "info", "claim", "handoff")  # fixed values
BOX = ("tenant_id", "recipient")


def accept(messages: DataFrame) -> DataFrame:
    """Adds ``outcome``: sensitive claims are refused before they are written."""
    return messages.withColumn(
        "outcome",
        F.when(~F.col("type").isin(*TYPES), "invalid_request")
        .when((F.col("type") == "claim") & sensitive(F.col("payload")), "classifier_escalate")
        .otherwise("pending"),
    )


def live(messages: DataFrame, now: Column, days: int = v.INBOX_TTL_DAYS) -> DataFrame:
    return messages.where(F.col("sent_at") + F.make_dt_interval(F.lit(days)) > now)


def capped(unread: DataFrame, cap: int = v.INBOX_CAP) -> DataFrame:
    """Unread messages that stay: all queries, and the newest others that fit the cap.

    At most ``cap`` others can stay in one box, so the window orders only that many.
    """
    is_query = F.col("type") == "query"
    queries = unread.where(is_query)
    n_query = queries.groupBy(*BOX).agg(F.count("*").alias("_q"))
    w = Window.partitionBy(*BOX).orderBy(F.desc("sent_at"), F.desc("msg_id"))
    others = (
        unread.where(~is_query).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
        .join(n_query, list(BOX), "left").where(F.col("_n") <= cap - F.coalesce("_q", F.lit(0))).drop("_n", "_q")
    )
    return union_all(queries, others)


def status(messages: DataFrame, kept: DataFrame, now: Column, days: int = v.INBOX_TTL_DAYS) -> DataFrame:
    """(msg_id, status): acked, delivered, expired, dropped_cap or pending."""
    k = kept.select("msg_id").withColumn("_k", F.lit(True))
    gone = F.col("sent_at") + F.make_dt_interval(F.lit(days)) <= now
    return messages.join(k, "msg_id", "left").select(
        "msg_id",
        F.when(F.col("acked_at").isNotNull(), "acked").when(F.col("delivered_at").isNotNull(), "delivered")
        .when(gone, "expired").when(F.col("_k").isNull(), "dropped_cap").otherwise("pending").alias("status"),
    )
