import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions import ids, scoring, text, vectors
from memspark.functions.common import lookup

NOW = datetime(2025, 12, 1, 12)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_worked_example(spark):
    """Three facts with known scores, and the contradiction weight of the second."""
    data = [
        ("preference", datetime(2025, 12, 1), 0.6, 0.58, 0, 0.1),
        ("user_fact", datetime(2025, 11, 24, 12), 0.4, 0.2, 0, 0.0),
    ]
    df = rows(spark, data, "kind string, seen timestamp, conn double, util double, n int, grav double")
    got = [
        r[0] for r in df.select(scoring.composed_score(
            F.col("kind"), F.lit(NOW), F.col("seen"), F.col("conn"), F.col("util"), F.col("n"), F.col("grav"), F.lit(False))).collect()
    ]
    want = [
        0.2 * 0.85 + 0.2 * 0.6 + 0.4 * 0.58,
        0.2 * 0.7 + 0.3 * (0.05 + 0.95 * math.exp(-7 / 30)) + 0.2 * 0.4 + 0.4 * 0.2,
    ]
    assert got == pytest.approx(want, abs=1e-12)
    assert want[0] == pytest.approx(0.522, abs=1e-3)


def test_gravity_makes_a_negative_score_worse(spark):
    r = one(
        spark, low=scoring.gravity_mult(F.lit(-0.453), F.lit(0.5), F.lit(False)) * -0.453,
        high=scoring.gravity_mult(F.lit(0.2), F.lit(1.0), F.lit(False)), gone=scoring.gravity_mult(F.lit(0.1), F.lit(1.0), F.lit(True)),
    )
    assert r.low == pytest.approx(-0.56625) and r.high == 1.0 and r.gone == 0.0


def test_recency_bounds(spark):
    r = one(
        spark, future=scoring.recency(F.lit(NOW), F.lit(datetime(2026, 1, 1))), now=scoring.recency(F.lit(NOW), F.lit(NOW)),
        old=scoring.recency(F.lit(NOW), F.lit(datetime(1990, 1, 1))),
    )
    assert r.future == 1.0 and r.now == 1.0 and r.old == pytest.approx(0.05, abs=1e-6)


def test_eps_is_log_damped(spark):
    r = one(spark, e=scoring.eps_effective(0.5, F.lit(1)))
    assert r.e == pytest.approx(0.8466, abs=1e-4)


@pytest.mark.parametrize("kind", ["reply_only", "escalate", "nonsense"])
def test_kinds_that_are_never_scored(spark, kind):
    df = rows(spark, [(kind,)], "kind string")
    score = scoring.additive_score(F.col("kind"), F.lit(NOW), F.lit(NOW), F.lit(0.1), F.lit(0.1), F.lit(0))
    with pytest.raises(Exception, match="never scored"):
        df.select(score).collect()
    with pytest.raises(Exception, match="kind"):
        df.select(scoring.shape_of(F.col("kind"))).collect()
    loose = scoring.additive_score(F.col("kind"), F.lit(NOW), F.lit(NOW), F.lit(0.1), F.lit(0.1), F.lit(0), strict=False)
    assert df.select(loose).first()[0] is None


def test_term_ranges(spark):
    df = rows(spark, [("narrative", 1.5)], "kind string, c double")
    with pytest.raises(Exception, match="out of range"):
        df.select(scoring.additive_score(F.col("kind"), F.lit(NOW), F.lit(NOW), F.col("c"), F.lit(0.0), F.lit(0))).collect()


def test_type_priority_default(spark):
    df = rows(spark, [(k,) for k in [*v.TYPE_PRIORITY, "else"]], "kind string")
    got = dict(df.select("kind", scoring.type_priority(F.col("kind"))).collect())
    assert got == {**v.TYPE_PRIORITY, "else": 0.30}


def test_rerank_example(spark):
    r = one(
        spark, a=scoring.rerank_score(F.lit(0.0489), F.lit(1.0), F.lit(0.9), F.lit(0.0), F.lit(0.4)),
        ramp0=scoring.utility_ramp(F.lit(999)), ramp1=scoring.utility_ramp(F.lit(5500)), ramp2=scoring.utility_ramp(F.lit(50000)),
        m=scoring.intent_match(F.lit("state_fact"), F.lit("user_fact")), none=scoring.intent_match(F.lit("drop"), F.lit("user_fact")),
    )
    assert r.a == pytest.approx(0.0555, abs=1e-3) and r.ramp0 == 0.0 and r.ramp1 == pytest.approx(0.1) and r.ramp2 == 0.2
    assert r.m == 1.0 and r.none == 0.0


def test_decision_boundaries(spark):
    df = rows(spark, [(0.7,), (0.69,), (0.2,), (0.199,)], "s double")
    assert [r[0] for r in df.select(scoring.decision(F.col("s"))).collect()] == ["promote", "keep", "keep", "demote"]


def test_lookup_is_a_case(spark):
    df = rows(spark, [("a",), ("z",)], "k string")
    assert [r[0] for r in df.select(lookup(F.col("k"), {"a": 1}, 9)).collect()] == [1, 9]


# --- ids ---
def _uuid7(ts_ms, seed):
    import hashlib
    import uuid

    bits = int.from_bytes(hashlib.sha256(seed.encode()).digest(), "big") >> 182
    value = (ts_ms << 80) | (7 << 76) | ((bits >> 62) << 64) | (2 << 62) | (bits & ((1 << 62) - 1))
    return str(uuid.UUID(int=value))


def test_recall_id_layout(spark):
    import hashlib

    queries = ["plain", "quote \" and \\ slash", "ñandú é", "tab\tnew\nline", ""]
    df = rows(spark, [(q, "tenant-a", None) for q in queries], "text string, tenant_id string, intent string")
    from memspark.plans.recall import recall_ids

    at = datetime(2025, 6, 1, 12, 0, 0, 123456)
    got = {r.text: r for r in recall_ids(df, F.lit(at), 5).collect()}
    ms = 1748779200123
    for q in queries:
        h = hashlib.sha256(ids.canonical_query_json(q, None, 5).encode()).hexdigest()[:16]
        assert got[q].query_hash == h
        assert got[q].recall_id == _uuid7(ms, "tenant-a" + h)
    assert df.select(F.min(ids.is_uuid7(F.lit(got["plain"].recall_id)))).first()[0]


def test_id_families_differ(spark):
    r = one(spark, **{d: ids.import_id(F.lit("t"), F.lit(NOW), d, F.lit("x")) for d in ("idem", "epi", "forget", "rollback")})
    assert len(set(r)) == 4 and all(x[14] == "7" for x in r)


def test_uuid7_check(spark):
    df = rows(spark, [("018f0000-0000-7000-8000-000000000000",), ("018F0000-0000-7000-B000-00000000000A",),
                      ("018f0000-0000-4000-8000-000000000000",), ("018f0000-0000-7000-c000-000000000000",), ("x",), (None,)], "k string")
    assert [r[0] for r in df.select(ids.is_uuid7(F.col("k"))).collect()] == [True, True, False, False, False, False]


def test_random_ids_are_version_7(spark):
    df = spark.range(50).select(ids.random_uuid7(F.lit(NOW)).alias("u"))
    assert df.where(ids.is_uuid7(F.col("u"))).select("u").distinct().count() == 50


def test_time_formats(spark):
    df = rows(spark, [(datetime(2024, 1, 1, 0, 0, 0, 123999),), (datetime(2024, 1, 1),)], "t timestamp")
    got = df.select(ids.iso_ms(F.col("t")), ids.iso_us(F.col("t"))).collect()
    assert tuple(got[0]) == ("2024-01-01T00:00:00.123Z", "2024-01-01T00:00:00.123999Z")
    assert tuple(got[1]) == ("2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00Z")
    texts = rows(spark, [("2024-01-01T00:00:00.5Z",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+00:00",)], "t string")
    assert texts.select(F.countDistinct(ids.parse_iso(F.col("t")))).first()[0] == 2


# --- text ---
def test_sensitive_text(spark):
    cases = {
        "my number is 123456789": True, "digits ١٢٣٤٥٦٧٨٩": True, "12345678": False, "sk-abcdefgh12": True, "xsk-abcdefgh12": False,
        "the PassWord is": True, "passwords": False, "api key": True, "api_key": True, "ésecret": False, "ſecret": True, "plain": False,
        "social-security": True, "apikey": True,
    }
    df = rows(spark, [(k,) for k in cases], "t string")
    assert dict(df.select("t", text.sensitive(F.col("t"))).collect()) == cases


def test_strip_is_unicode_aware(spark):
    r = one(spark, s=text.strip(F.lit("  \t abc \n")))
    assert r.s == "abc"


def test_classifier_order(spark):
    data = [
        ("ok", "utterance", None, None, False, None, None), ("ok 1", "utterance", None, None, False, None, None),
        ("hello there my friends", "peer_message", "info", None, False, None, None),
        ("hello there my friends", "peer_message", "claim", None, False, None, None),
        ("hello there my friends", "peer_message", "claim", "drop", False, None, None),
        ("hello there my friends", "tool_call_result", "idempotent", None, False, None, None),
        ("hello there my friends", "tool_call_result", None, None, False, "escalate", 0.9),
        ("my secret", "utterance", None, "remember:fact", True, None, None), ("my secret", "utterance", None, "remember:fact", False, None, None),
        ("hello there my friends", "utterance", None, "remember:preference", False, "drop", 0.79),
        ("hello there my friends", "utterance", None, "remember:preference", False, "drop", 0.8),
    ]
    df = rows(spark, data, "p string, sk string, ss string, tag string, f boolean, mi string, ms double")
    c = text.classify(F.col("p"), F.col("sk"), F.col("ss"), F.col("tag"), F.col("f"), F.col("mi"), F.col("ms"))
    got = [tuple(r) for r in df.select(c.alias("c")).select("c.*").collect()]
    assert got == [
        ("drop", 0.95, "heuristic", ""), ("remember:fact", 0.5, "heuristic", "llm_unavailable"), ("reply_only", 0.9, "heuristic", ""),
        ("remember:fact", 0.4, "heuristic", "llm_unavailable"), ("drop", 0.4, "caller_tagged", "llm_unavailable"),
        ("remember:procedure", 0.9, "heuristic", ""), ("escalate", 0.9, "llm", ""), ("remember:fact", 1.0, "caller_tagged", "force_skip"),
        ("escalate", 1.0, "heuristic", ""), ("remember:preference", 0.79, "caller_tagged", "caller_override"), ("drop", 0.8, "llm", ""),
    ]


def test_forced_without_tag_fails(spark):
    df = rows(spark, [("x",)], "p string")
    with pytest.raises(Exception, match="caller tag"):
        df.select(text.classify(F.col("p"), F.lit("utterance"), F.lit(None).cast("string"), None, F.lit(True))).collect()


def test_hash_vector(spark):
    import hashlib

    for s in ("", "Ünïcode", "abc"):
        raw = [(b - 127.5) / 127.5 for b in hashlib.sha256(s.encode()).digest()]
        n = math.sqrt(sum(x * x for x in raw))
        got = one(spark, v=vectors.hash_vector(F.lit(s))).v
        assert got == pytest.approx([round(x / n, 8) for x in raw], abs=1e-12)


def test_vector_expressions(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))
    r = one(spark, d=vectors.l2_distance(a, b), s=vectors.similarity(F.lit(1.0)), c=vectors.cosine(a, a), z=vectors.cosine(a, b))
    assert r.d == 5.0 and r.s == 0.5 and r.c == pytest.approx(1.0) and r.z == 0.0
