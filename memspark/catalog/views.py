"""The memory tables as column expressions over the given parquet tables.

``Views`` is the Spark side, ``CTE`` holds the same definitions for the SQL side.  All rows of
every table are used; the expressions only rename, combine and label columns.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.session import dealt, prepare, spread

KINDS = ("user_fact", "project_fact", "feedback", "reference", "preference", "prohibition", "procedure", "narrative")
LEDGER_KIND = {
    "signup": "citation", "purchase": "tool_success", "error": "correction", "view": "repeat_recall", "click": "no_op",
}
DIM = 64
SUPPLY_KEYS = ("l_orderkey", "l_suppkey")  # of a pair of the supply graph
ORDER_KEYS = ("o_custkey", "o_orderkey")  # of a pair of the order graph
T_NOW = "2024-02-15"
T_LEDGER = "2024-01-25"
DAY0 = 1704067200  # 2024-01-01 00:00:00 UTC in seconds


def clock(text: str) -> Column:
    return F.to_timestamp(F.lit(text + " 00:00:00"))


def at_day(day: Column) -> Column:
    return F.timestamp_seconds(F.lit(DAY0) + day * 86400)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        scan = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(scan) if name in ("documents", "pages") else scan

    @cached_property
    def facts(self) -> DataFrame:
        d = self.table("documents")
        i = F.col("doc_id")
        vf = at_day(i % 60)
        return d.select(
            i.alias("doc_id"),
            F.concat(F.lit("tenant-"), (i % 10).cast("string")).alias("tenant_id"),
            F.concat(F.lit("f-"), F.lpad(i.cast("string"), 8, "0")).alias("fact_id"),
            F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % 8 + 1).cast("int")).alias("kind"),
            F.col("text").alias("content"),
            vf.alias("valid_from"),
            F.when(i % 5 == 0, at_day(i % 60 + (i % 7 + 1) * 10)).alias("valid_to"),
            vf.alias("recorded_at"),
            F.when(i % 17 != 0, F.concat(F.lit("ep-"), i.cast("string"))).alias("episode_id"),
            F.lit(1).cast("bigint").alias("version"),
            F.col("source").alias("source_uri"),
            F.col("lang").alias("lang"),
            F.col("n_chars"),
        )

    @cached_property
    def fact_vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.concat(F.lit("tenant-"), (F.col("vec_id") % 10).cast("string")).alias("tenant_id"),
            F.concat(F.lit("f-"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("fact_id"),
            F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("label"), "vec_id",
        )

    @cached_property
    def query_batch(self) -> DataFrame:
        """One query per benchmark item, with the item's vector where there is one."""
        b = self.table("benchmark")
        e = self.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
        return b.join(e, "item_id", "left").select(
            F.concat(F.lit("q-"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("query_id"),
            F.concat(F.lit("tenant-"), (F.col("item_id") % 10).cast("string")).alias("tenant_id"),
            "item_id", "text", "vec",
            F.element_at(
                F.array(F.lit("update_preference"), F.lit("state_fact"), F.lit("procedure_lookup"), F.lit("narrative_recall")),
                (F.col("item_id") % 4 + 1).cast("int"),
            ).alias("intent"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Utility events: the user is the fact, the event type the feedback kind."""
        return self.ledger_of(self.table("events"))

    @staticmethod
    def ledger_of(e: DataFrame) -> DataFrame:
        kind = None
        for k, val in LEDGER_KIND.items():
            kind = F.when(F.col("event_type") == k, val) if kind is None else kind.when(F.col("event_type") == k, val)
        return e.select(
            "event_id", F.concat(F.lit("tenant-"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
            F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("fact_id"),
            kind.alias("event_kind"), F.col("ts").cast("timestamp").alias("ts"), "value", "props",
        )

    @cached_property
    def order_graph(self) -> DataFrame:
        """Customers and their orders, both directions, weighted by order value."""
        return self._order_edges(self.table("orders"))

    @cached_property
    def dealt_order_graph(self) -> DataFrame:
        """The same, dealt by ORDER_KEYS, which it keeps; for sums per pair."""
        o = self.table("orders").select(*ORDER_KEYS, "o_totalprice")
        return self._order_edges(dealt(o, *ORDER_KEYS), ORDER_KEYS)

    @staticmethod
    def _order_edges(o: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        c = F.concat(F.lit("c-"), F.col("o_custkey").cast("string"))
        k = F.concat(F.lit("o-"), F.col("o_orderkey").cast("string"))
        w = F.col("o_totalprice").cast("double")
        pair = F.explode(F.array(
            F.struct(c.alias("src"), k.alias("dst"), w.alias("weight")),
            F.struct(k.alias("src"), c.alias("dst"), w.alias("weight")),
        ))
        return o.select(*keep, pair.alias("e")).select(*keep, "e.*")

    @cached_property
    def supply_graph(self) -> DataFrame:
        """Orders and suppliers, both directions, weighted by quantity; suppliers are hubs.  Dealt by SUPPLY_KEYS, which it keeps."""
        li = dealt(self.table("lineitem").select(*SUPPLY_KEYS, "l_quantity"), *SUPPLY_KEYS)
        pairs = li.groupBy(*SUPPLY_KEYS).agg(F.sum("l_quantity").cast("double").alias("weight"))
        o = F.concat(F.lit("o-"), F.col("l_orderkey").cast("string"))
        s = F.concat(F.lit("s-"), F.col("l_suppkey").cast("string"))
        both = F.explode(F.array(
            F.struct(o.alias("src"), s.alias("dst"), F.col("weight").alias("weight")),
            F.struct(s.alias("src"), o.alias("dst"), F.col("weight").alias("weight")),
        ))
        return pairs.select(*SUPPLY_KEYS, both.alias("e")).select(*SUPPLY_KEYS, "e.*")

    @cached_property
    def episodes(self) -> DataFrame:
        c = self.table("conversations")
        kind = (
            F.when(F.col("role") == "user", "utterance").when(F.col("role") == "assistant", "peer_message")
            .otherwise("tool_call_result")
        )
        sub = (
            F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 0), "info")
            .when(F.col("role") == "assistant", "claim")
            .when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), "idempotent")
        )
        return c.select(
            F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("episode_id"),
            F.concat(F.lit("tenant-"), (F.col("conv_id") % 10).cast("string")).alias("tenant_id"),
            F.col("text").alias("body"), kind.alias("source_kind"), sub.alias("source_subtype"),
            F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("source_uri"),
            F.timestamp_seconds(F.lit(DAY0) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts_recorded"),
            "conv_id", "turn", "role",
        )

    @cached_property
    def pages(self) -> DataFrame:
        p = self.table("pages")
        return p.select(
            F.concat(F.lit("tenant-"), (F.col("page_id") % 10).cast("string")).alias("tenant_id"),
            F.col("url").alias("page_uri"), F.col("html").alias("content"),
            F.when(F.col("page_id") % 3 == 0, "prohibition").otherwise("preference").alias("kind"),
            F.concat(F.lit("rev-"), F.col("page_id").cast("string")).alias("revision_id"),
            F.timestamp_seconds(F.lit(DAY0) + F.col("page_id") * 3600).alias("revised_at"),
            F.octet_length("html").cast("bigint").alias("bytes"), "page_id",
        )

    @cached_property
    def flags(self) -> DataFrame:
        """Facts of low quality are demoted; labels tell, and they lie in every tenant."""
        d = self.table("labels").where(F.col("quality") == 0)
        return d.select(
            F.concat(F.lit("tenant-"), (F.col("doc_id") % 10).cast("string")).alias("tenant_id"),
            F.concat(F.lit("f-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("fact_id"),
            F.lit("demoted").alias("tier"), F.col("doc_id").alias("seq"),
        )


# --- the same views for the SQL side ------------------------------------------------------
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_LEDGER_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in LEDGER_KIND.items()) + " END"

CTE = {
    "facts": f"""facts AS (
  SELECT doc_id, 'tenant-' || CAST(doc_id % 10 AS VARCHAR) AS tenant_id,
    'f-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS fact_id,
    ({_KIND_SQL})[CAST(doc_id % 8 + 1 AS INTEGER)] AS kind, text AS content,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS valid_from,
    CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01'
      + to_days(CAST(doc_id % 60 + (doc_id % 7 + 1) * 10 AS INTEGER)) END AS valid_to,
    CASE WHEN doc_id % 17 <> 0 THEN 'ep-' || CAST(doc_id AS VARCHAR) END AS episode_id,
    source AS source_uri, lang, n_chars
  FROM documents)""",
    "fact_vectors": """fact_vectors AS (
  SELECT 'tenant-' || CAST(vec_id % 10 AS VARCHAR) AS tenant_id,
    'f-' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS fact_id, CAST(embedding AS DOUBLE[]) AS vec,
    CAST(label AS BIGINT) AS label, vec_id FROM embeddings)""",
    "query_batch": """query_batch AS (
  SELECT 'q-' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS query_id,
    'tenant-' || CAST(item_id % 10 AS VARCHAR) AS tenant_id, item_id, text,
    CAST(embedding AS DOUBLE[]) AS vec,
    (['update_preference', 'state_fact', 'procedure_lookup', 'narrative_recall'])[CAST(item_id % 4 + 1 AS INTEGER)] AS intent
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)""",
    "ledger": f"""ledger AS (
  SELECT event_id, 'tenant-' || CAST(user_id % 10 AS VARCHAR) AS tenant_id,
    'u-' || CAST(user_id AS VARCHAR) AS fact_id, {_LEDGER_SQL} AS event_kind, ts, value, props FROM events)""",
    "order_graph": """order_graph AS (
  SELECT 'c-' || CAST(o_custkey AS VARCHAR) AS src, 'o-' || CAST(o_orderkey AS VARCHAR) AS dst,
    CAST(o_totalprice AS DOUBLE) AS weight FROM orders
  UNION ALL
  SELECT 'o-' || CAST(o_orderkey AS VARCHAR), 'c-' || CAST(o_custkey AS VARCHAR), CAST(o_totalprice AS DOUBLE) FROM orders)""",
    "supply_graph": """supply_pairs AS (
  SELECT 'o-' || CAST(l_orderkey AS VARCHAR) AS o, 's-' || CAST(l_suppkey AS VARCHAR) AS s,
    CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL),
supply_graph AS (
  SELECT o AS src, s AS dst, weight FROM supply_pairs UNION ALL SELECT s, o, weight FROM supply_pairs)""",
    "episodes": f"""episodes AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS episode_id,
    'tenant-' || CAST(conv_id % 10 AS VARCHAR) AS tenant_id, text AS body,
    CASE role WHEN 'user' THEN 'utterance' WHEN 'assistant' THEN 'peer_message' ELSE 'tool_call_result' END AS source_kind,
    CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN 'info' WHEN role = 'assistant' THEN 'claim'
      WHEN role = 'system' AND conv_id % 2 = 0 THEN 'idempotent' END AS source_subtype,
    CASE WHEN conv_id % 7 <> 0 THEN 'conv:' || CAST(conv_id AS VARCHAR) END AS source_uri,
    make_timestamp(({DAY0} + conv_id * 3600 + turn * 60) * 1000000) AS ts_recorded, conv_id, turn, role
  FROM conversations)""",
    "pages_v": f"""pages_v AS (
  SELECT 'tenant-' || CAST(page_id % 10 AS VARCHAR) AS tenant_id, url AS page_uri, html AS content,
    CASE WHEN page_id % 3 = 0 THEN 'prohibition' ELSE 'preference' END AS kind,
    'rev-' || CAST(page_id AS VARCHAR) AS revision_id,
    make_timestamp(({DAY0} + page_id * 3600) * 1000000) AS revised_at,
    CAST(strlen(html) AS BIGINT) AS bytes, page_id FROM pages)""",
    "flags": """flags AS (
  SELECT 'tenant-' || CAST(doc_id % 10 AS VARCHAR) AS tenant_id, 'f-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS fact_id,
    'demoted' AS tier, doc_id AS seq FROM labels WHERE quality = 0)""",
}


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views."""
    return "WITH " + ",\n".join(CTE[n] for n in names)
