"""The write verb for a batch of requests: check, classify, branch."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import blank
from memspark.functions.ids import iso_us, uuid7_from_text
from memspark.functions.text import classify, retention_class
from memspark.operators import idempotency

REQUEST_COLUMNS = (
    "seq", "tenant_id", "principal", "content", "idempotency_key", "source_uri", "agent_id", "derived_from",
    "intent", "kind", "force_skip", "source_kind", "source_subtype", "at",
)


@dataclass(frozen=True)
class Remembered:
    """``judged`` holds every request with its outcome; the others are rows to append."""

    judged: DataFrame
    episodes: DataFrame
    review_queue: DataFrame
    audit_log: DataFrame
    idempotency_keys: DataFrame
    events: DataFrame


def request_hash(rows: DataFrame) -> Column:
    fields = ("content", "force_skip", "intent", "kind", "source_kind", "source_subtype", "source_uri", "agent_id", "derived_from", "tenant_id")
    return idempotency.body_hash(*[F.col(f) for f in sorted(fields)])


def judge(requests: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Adds body_hash, outcome, intent, confidence, path, retention_class and http_status."""
    rows = requests.withColumn("body_hash", request_hash(requests)).withColumn("verb", F.lit("remember")).withColumn(
        "key", F.col("idempotency_key")
    )
    keyed = idempotency.classify(rows, stored_keys).withColumnRenamed("outcome", "_key_state").drop("key", "verb")
    forced = F.coalesce(F.col("force_skip"), F.lit(False))
    broken = (
        F.when(F.col("_key_state").isin("missing", "malformed"), F.lit("missing_idempotency_key"))
        .when(F.col("_key_state") == "conflict", F.lit("idempotency_conflict"))
        .when(F.col("_key_state") == "replay", F.lit("replay"))
        .when(blank(F.col("source_uri")), F.lit("provenance_required"))
        .when(forced & F.col("intent").isNull(), F.lit("missing_caller_tag"))
    )
    # a broken request is not classified, so a missing tag is an answer and not a task failure
    model_i = F.col("model_intent") if "model_intent" in requests.columns else None
    model_s = F.col("model_score") if "model_score" in requests.columns else None
    verdict = classify(
        F.col("content"), F.col("source_kind"), F.col("source_subtype"), F.col("intent"), forced & F.col("intent").isNotNull(),
        model_i, model_s,
    )
    rows = keyed.withColumn("_broken", broken).withColumn("_c", F.when(F.col("_broken").isNull(), verdict))
    cls = F.col("_c.intent")
    outcome = (
        F.when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(cls == "peer_route", F.lit("use_peer_message"))
        .when(cls.isin("drop", "reply_only"), F.lit("dropped"))
        .when(cls == "escalate", F.lit("staged_for_review"))
        .otherwise(F.lit("synchronous_durable"))
    )
    status = (
        F.when(outcome == "idempotency_conflict", 409)
        .when(outcome.isin("missing_idempotency_key", "provenance_required", "missing_caller_tag", "use_peer_message"), 400)
        .when(outcome == "staged_for_review", 422).otherwise(200)
    )
    kept = F.when(cls == "escalate", retention_class(F.lit("remember:fact"), F.col("kind"))).otherwise(
        retention_class(cls, F.col("kind"))
    )
    return rows.select(
        *[c for c in requests.columns], "body_hash", outcome.alias("outcome"), cls.alias("classified"),
        F.col("_c.confidence").alias("confidence"), F.col("_c.path").alias("path"), F.col("_c.detail").alias("audit_detail"),
        F.when(cls.isNotNull(), kept).alias("retention_class"), status.alias("http_status"),
    )


def remember(requests: DataFrame, stored_keys: DataFrame, staged: DataFrame | None = None) -> Remembered:
    """Rows to append for a batch.

    Episode ids are random, so ``staged`` should be the judged batch as read back from where it
    was written (see :func:`stage`); the tables below then agree on the ids even when a task is
    run again.
    """
    judged = staged if staged is not None else stage_columns(judge(requests, stored_keys))
    ok = judged.where(F.col("outcome") == "synchronous_durable")
    response = F.struct(
        "episode_id", "idempotency_key",
        F.struct(F.col("classified").alias("class"), "confidence", "path").alias("classified_intent"), "retention_class",
        (F.col("outcome") == "synchronous_durable").alias("accepted"), (F.col("outcome") == "staged_for_review").alias("escalated"),
        F.col("outcome").alias("ack"), iso_us(F.col("at")).alias("applied_at"), "http_status",
    )
    recorded = judged.where(F.col("outcome").isin("dropped", "staged_for_review", "synchronous_durable"))
    return Remembered(
        judged,
        ok.select(
            "tenant_id", "episode_id", F.col("content").alias("body"), "source_uri", F.col("at").alias("ts_recorded"),
            F.col("classified").alias("intent"),
        ),
        judged.where(F.col("outcome") == "staged_for_review").select(
            F.col("episode_id").alias("staged_id"), "tenant_id", F.lit("remember").alias("source_verb"),
            F.col("principal").alias("source_principal"), F.col("at").alias("staged_at"),
            F.to_json(F.struct("content", "intent", "kind", "source_uri"), {"ignoreNullFields": "false"}).alias("payload_blob"),
            F.col("classified").alias("classifier_class"), F.col("confidence").alias("classifier_score"),
            F.lit("pending_review").alias("status"),
            (F.col("at") + F.make_dt_interval(F.lit(v.REVIEW_TTL_DAYS))).alias("expires_at"),
        ),
        ok.where(F.col("audit_detail") == "force_skip").select(
            F.col("at").alias("created_at"), "tenant_id", F.lit("remember").alias("verb"), "principal",
            F.lit("force_skip_classifier_invoked").alias("action"),
            F.to_json(F.struct(F.col("intent").alias("caller_tag"), F.col("idempotency_key").alias("request_idempotency_key"))).alias("payload_json"),
        ),
        recorded.select(
            "tenant_id", F.col("idempotency_key").alias("key"), F.lit("remember").alias("verb"), "body_hash",
            idempotency.pack(F.col("body_hash"), response).alias("response_blob"), F.col("at").alias("created_at"),
            idempotency.expires_at(F.col("at")).alias("expires_at"),
        ),
        ok.select(
            _id("event").alias("event_id"), F.lit("remember").alias("event_type"), "tenant_id",
            iso_us(F.col("at")).alias("ts_recorded"), iso_us(F.col("at")).alias("ts_valid"),
            F.lit(v.INGEST_VERSIONS[0]).alias("model_version"), F.lit(v.INGEST_VERSIONS[1]).alias("weights_version"),
            F.lit(True).alias("contamination_protected"), F.array("episode_id").alias("fact_ids"),
            F.struct(F.col("classified").alias("class"), "confidence", "path", "retention_class").alias("decision"),
            F.struct(
                "episode_id", "source_uri", F.coalesce("agent_id", "principal").alias("agent_id"),
                iso_us(F.col("at")).alias("recorded_at"), "derived_from",
            ).alias("provenance"),
        ),
    )


def stage_columns(judged: DataFrame) -> DataFrame:
    """Adds the episode id of every request that gets a record.

    It follows from time, tenant and key, so all tables of one batch agree however often a task is repeated.
    """
    return judged.withColumn("episode_id", _id("episode"))


def _id(what: str) -> Column:
    return uuid7_from_text(F.unix_millis("at"), F.concat_ws("/", F.lit(what), F.col("tenant_id"), F.col("idempotency_key")))


def stage(judged: DataFrame, path: str) -> DataFrame:
    """Write the judged batch with its ids and read it back, so that the ids are settled."""
    stage_columns(judged).write.mode("overwrite").parquet(path)
    return judged.sparkSession.read.parquet(path)
