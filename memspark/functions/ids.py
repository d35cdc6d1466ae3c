"""Deterministic identifiers and time formats."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark import vocab as v

_HEX = "0123456789abcdef"


def iso_ms(ts: Column) -> Column:
    """``2024-02-15T00:00:00.000Z``; finer digits are cut, not rounded."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_us(ts: Column) -> Column:
    """Microsecond form; the fraction is left out when it is zero."""
    frac = F.date_format(ts, "SSSSSS")
    body = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(body, F.when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)), F.lit("Z"))


def parse_iso(text: Column) -> Column:
    """Timestamp of any of the three written forms (ms+Z, us+Z, +00:00); compare these, never the text."""
    return F.to_timestamp(text)


def canonical_query_json(query: str, intent: str | None, k: int, scope: dict | None = None) -> str:
    """The hashed form of one request: sorted keys, tight separators, non-ASCII kept."""
    body = {"query": query, "intent": intent or "unspecified", "k": k, "scope": dict(scope or {})}
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def query_json(query: Column, intent: Column, k: Column, scope_json: Column) -> Column:
    """Column form of :func:`canonical_query_json`; ``scope_json`` is already canonical."""
    quoted = F.regexp_extract(F.to_json(F.struct(query.alias("q"))), r'(?s)^\{"q":(.*)\}$', 1)
    label = F.when(F.coalesce(intent, F.lit("")) == "", F.lit("unspecified")).otherwise(intent)
    quoted_intent = F.regexp_extract(F.to_json(F.struct(label.alias("q"))), r'(?s)^\{"q":(.*)\}$', 1)
    return F.concat(
        F.lit('{"intent":'), quoted_intent,
        F.lit(',"k":'), k.cast("string"),
        F.lit(',"query":'), quoted,
        F.lit(',"scope":'), scope_json,
        F.lit("}"),
    )


def query_hash(canonical_json: Column) -> Column:
    return F.substring(F.sha2(canonical_json, 256), 1, 16)


def uuid7_from_text(ts_ms: Column, seed_text: Column) -> Column:
    """UUID version 7 whose 74 free bits are the leading bits of ``sha256(seed_text)``.

    Digest bits 0-11 go behind the version nibble.  The two variant bits shift the
    next 62 bits, so each of those hex digits mixes two neighbouring digest digits;
    the arithmetic below is done once on a 64-bit value.
    """
    digest = F.sha2(seed_text, 256)
    rand_a = F.substring(digest, 1, 3)
    # digest bits 12..75 as one long, then drop the last two bits and set the variant
    window = F.conv(F.substring(digest, 4, 16), 16, -10).cast("long")
    tail = F.shiftrightunsigned(window, 2).bitwiseOR(F.lit(-(1 << 63)))
    tail_hex = F.lower(F.hex(tail))
    ts_hex = F.lpad(F.lower(F.hex(ts_ms)), 12, "0")
    return F.concat_ws(
        "-",
        F.substring(ts_hex, 1, 8),
        F.substring(ts_hex, 9, 4),
        F.concat(F.lit("7"), rand_a),
        F.substring(tail_hex, 1, 4),
        F.substring(tail_hex, 5, 12),
    )


def recall_id(tenant_id: Column, ts: Column, qhash: Column) -> Column:
    return uuid7_from_text(F.unix_millis(ts), F.concat(tenant_id, qhash))


def import_id(tenant_id: Column, ts: Column, discriminant: str, source_id: Column) -> Column:
    """Ids of a bulk import; the discriminant keeps the id families disjoint."""
    return uuid7_from_text(F.unix_millis(ts), F.concat(tenant_id, F.lit(discriminant), source_id))


def page_id(uri: Column) -> Column:
    """First 16 bytes of ``sha256(uri)`` in UUID form, with no version bits."""
    d = F.sha2(uri, 256)
    return F.concat_ws(
        "-",
        F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12),
    )


def random_uuid7(ts: Column) -> Column:
    """Random version 7 id stamped with ``ts``; not reproducible, so never compared."""
    ts_hex = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    u = F.expr("uuid()")
    return F.concat(
        F.substring(ts_hex, 1, 8), F.lit("-"), F.substring(ts_hex, 9, 4), F.lit("-7"), F.substring(u, 16, 21)
    )


def is_uuid7(text: Column) -> Column:
    return F.coalesce(text.rlike(v.UUID7), F.lit(False))


def mint_uri(tenant_id: Column, relative_path: Column) -> Column:
    return F.concat(F.lit("s4a://"), tenant_id, F.lit("/"), relative_path)
