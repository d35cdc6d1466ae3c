"""Replay and conflict detection by idempotency key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.common import blank
from memspark.functions.ids import is_uuid7


KEY = ("tenant_id", "key", "verb")


def storage_key(verb: Column, key: Column) -> Column:
    return F.concat(verb, F.lit(":"), key)


def key_state(key: Column) -> Column:
    return F.when(blank(key), F.lit("missing")).when(~is_uuid7(key), F.lit("malformed")).otherwise(F.lit("ok"))


def body_hash(*fields: Column) -> Column:
    """SHA-256 over a JSON object of the request fields (missing ones written as null)."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def expires_at(at: Column, hours: int = v.IDEMPOTENCY_TTL_HOURS) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(hours))


def classify(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``outcome``: fresh, replay, conflict, missing or malformed.

    ``requests(tenant_id, key, verb, body_hash, at, seq)`` is one batch, shorter than the retention time;
    ``stored(tenant_id, key, verb, body_hash, expires_at)`` the recorded keys, one row per tenant, key and verb.
    Tenants may use the same keys.
    Without a live stored row the first request of a key (by ``at``, ``seq``) is the fresh one.
    """
    checked = requests.withColumn("_state", key_state(F.col("key")))
    live = stored.select(*KEY, F.col("body_hash").alias("_stored"), "expires_at")
    with_stored = checked.join(live, list(KEY), "left").withColumn(
        "_stored", F.when(F.col("expires_at") > F.col("at"), F.col("_stored"))
    ).drop("expires_at")
    opener = (
        with_stored.where((F.col("_state") == "ok") & F.col("_stored").isNull()).groupBy(*KEY)
        .agg(F.min(F.struct("at", "seq", "body_hash")).alias("_first"))
    )
    outcome = (
        F.when(F.col("_state") != "ok", F.col("_state"))
        .when(F.col("_stored").isNotNull(), F.when(F.col("_stored") == F.col("body_hash"), "replay").otherwise("conflict"))
        .when(F.col("_first.seq") == F.col("seq"), F.lit("fresh"))
        .when(F.col("_first.body_hash") == F.col("body_hash"), F.lit("replay"))
        .otherwise(F.lit("conflict"))
    )
    return with_stored.join(opener, list(KEY), "left").withColumn("outcome", outcome).drop("_state", "_stored", "_first")


def pack(body_hash_: Column, response: Column) -> Column:
    """Stored response envelope, version 1."""
    return F.to_json(F.struct(body_hash_.alias("body_hash"), response.alias("response"), F.lit(1).alias("version")))


def unpack(blob: Column, response_schema: str) -> Column:
    """struct(body_hash, response); a blob of another shape or version fails the task."""
    parsed = F.from_json(blob, f"body_hash string, response {response_schema}, version int")
    bad = parsed.isNull() | (F.coalesce(parsed["version"], F.lit(-1)) != 1) | parsed["body_hash"].isNull() | parsed["response"].isNull()
    return F.when(bad, F.raise_error(F.lit("stored response is corrupt"))).otherwise(
        F.struct(parsed["body_hash"].alias("body_hash"), parsed["response"].alias("response"))
    )
