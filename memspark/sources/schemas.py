"""Declared table schemas with their version history; nothing is inferred."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURRENT_VERSION = 4


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema of ``name type, name type, …``, usable before a session exists."""
    pairs = (c.split(" ") for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "tenant_config": _schema("key string, value string, updated_at timestamp"),
    "scoring_weight_overrides": _schema("weight_key string, weight_value double, updated_at timestamp"),
    "review_queue": _schema(
        "staged_id string, tenant_id string, source_verb string, source_principal string, staged_at timestamp, "
        "payload_blob string, classifier_class string, classifier_score double, status string, "
        "reviewer_principal string, reviewed_at timestamp, review_reason string, expires_at timestamp"
    ),
    "idempotency_keys": _schema("key string, verb string, response_blob string, created_at timestamp, expires_at timestamp"),
    "extraction_log": _schema(
        "id bigint, episode_id string, extracted_at timestamp, extractor_version string, confidence double, payload_blob binary"
    ),
    "audit_log": _schema(
        "id bigint, created_at timestamp, tenant_id string, verb string, principal string, action string, payload_json string"
    ),
    "recall_ledger": _schema(
        "recall_id string, tenant_id string, query_hash string, ts_recorded timestamp, classified_intent string, "
        "weights_version string, top_k_fact_ids array<string>, response_envelope_blob string, created_at timestamp"
    ),
    "consolidation_state": _schema(
        "tenant_id string, lock_token string, lock_acquired_at timestamp, lock_heartbeat_at timestamp, last_run_cursor string, "
        "last_run_at timestamp, cascade_cost_99pct double, created_at timestamp, updated_at timestamp"
    ),
    "promotion_flags": _schema(
        "tenant_id string, fact_id string, tier string, flag_set_at timestamp, flag_set_by string, reason string"
    ),
    "utility_events": _schema(
        "id bigint, tenant_id string, fact_id string, event_kind string, event_weight double, ts_recorded timestamp, frozen boolean"
    ),
    "s5_consolidation_log": _schema("seq bigint, kind string, payload_json string, appended_at timestamp"),
}
STORES: dict[str, T.StructType] = {
    "episodes": _schema("tenant_id string, episode_id string, body string, source_uri string, ts_recorded timestamp, intent string"),
    "facts": _schema(
        "tenant_id string, fact_id string, kind string, content string, valid_from timestamp, valid_to timestamp, "
        "recorded_at timestamp, episode_id string, version bigint, source_uri string"
    ),
    "edges": _schema("tenant_id string, src string, dst string, weight double"),
    "embeddings": _schema("rowid bigint, embedding array<float>"),
    "embedding_keys": _schema("rowid bigint, node_id string, edge_id string, episode_id string"),
    "preference_pages": _schema(
        "tenant_id string, page_uri string, content string, kind string, revision_id string, revised_at timestamp, bytes bigint"
    ),
    "synthesis_pages": _schema(
        "tenant_id string, page_uri string, title string, kind string, frontmatter map<string,string>, content string, "
        "revision_id string, score double, provenance string"
    ),
}
# table -> schema version that introduced it
SINCE = {"recall_ledger": 2, "consolidation_state": 3, "promotion_flags": 3, "utility_events": 4}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], {**TABLES, **STORES}[name])


def tables_at(version: int) -> list[str]:
    return [t for t in TABLES if SINCE.get(t, 1) <= version]


def upgrade(df: DataFrame, name: str) -> DataFrame:
    """Bring rows of an older version to the current columns; missing ones become NULL.

    A column this version does not know means a newer writer, and is refused.
    """
    schema = {**TABLES, **STORES}[name]
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"{name}: columns of a newer version: {unknown}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])
