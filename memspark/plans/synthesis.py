"""Recall of authored pages, by address or by text query.  No validity filter applies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import ids
from memspark.functions.common import fail_when
from memspark.operators import bm25

WEIGHTS_VERSION = "synthesis-passthrough"  # fixed value
INTENTS = ("synthesis_uri", "synthesis_query")  # fixed values


def by_uri(pages: DataFrame, requests: DataFrame, strict: bool = True) -> DataFrame:
    """Pages for ``requests(query_id, tenant_id, uri[, revision_id])``; an unknown address fails the job when strict.

    A request that names a revision gets that one; without the column every page at the address is an answer.
    """
    at = ["tenant_id", "uri"] + [c for c in ("revision_id",) if c in requests.columns]
    p = pages.withColumn("uri", F.col("page_uri")).select(*at, "content", F.lit(True).alias("_found"))
    rows = requests.join(p, at, "left")
    if not strict:
        rows = rows.where(F.col("_found"))
    missing = F.concat(F.lit("no page at "), F.col("uri"))
    return rows.select(
        "query_id", "tenant_id", fail_when(F.col("_found").isNull(), missing, F.col("uri")).alias("page_uri"), "content",
        F.lit(1).alias("rank"),
    )


def by_query(pages: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """The k best pages of the request's own tenant: (query_id, page_uri, score, rank).

    Word statistics cover the tenant's own pages.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    by = ("tenant_id",)
    terms = bm25.query_terms(requests, by=by)
    small = bm25.has_at_most(terms, bm25.VOCABULARY_LIMIT)
    index = bm25.postings(
        pages.select("tenant_id", F.col("page_uri").alias("fact_id"), "content"), vocabulary=terms if small else None, by=by
    )
    scored = bm25.scores(index, terms, small=small, by=by)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    return (
        scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("query_id", F.col("fact_id").alias("page_uri"), "score", "rank")
    )


def request_ids(requests: DataFrame, ts: Column, k: int, intent: str) -> DataFrame:
    """Adds query_hash and recall_id; the intent label keeps page recalls apart from fact recalls."""
    if intent not in INTENTS:
        raise ValueError(intent)
    text = F.col("uri") if intent == INTENTS[0] else F.col("text")
    h = ids.query_hash(ids.query_json(text, F.lit(intent), F.lit(k), F.lit("{}")))
    rows = requests.withColumn("query_hash", h)
    return rows.withColumn("recall_id", ids.recall_id(F.col("tenant_id"), ts, F.col("query_hash")))


def event_rows(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(recall_id, page id) per returned page, for the event stream and the ledger."""
    return answers.join(requests.select("query_id", "recall_id"), "query_id").select(
        "recall_id", ids.page_id(F.col("page_uri")).alias("fact_id"), F.lit("synthesis").alias("path")
    )
