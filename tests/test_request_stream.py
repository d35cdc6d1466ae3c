"""Late rows, keyed state and forward decay in streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.operators import upsert
from memspark.operators import utility as ut
from memspark.streaming import requests, windows

SCHEMA = "tenant_id string, key string, verb string, body_hash string, at timestamp, seq int"
T0 = datetime(2024, 1, 1)


def arrive(spark, path, *files):
    """Each list of (tenant, key, hash, hours, seq) is a file, in this order."""
    for rows in files:
        data = [(t, k, "put", h, None if at is None else T0 + timedelta(hours=at), s) for t, k, h, at, s in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/arrived")
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrived")


def test_no_row_is_lost(spark, tmp_path):
    path = str(tmp_path)
    stream = arrive(
        spark, path,
        [("a", "k", "x", 0, 0), ("a", "k", "x", 1, 0), ("a", "k", "y", 2, 0), ("b", "k", "y", 2, 1), ("a", "none", "z", None, 2)],
        [("a", "k", "y", 23, 0), ("a", "k", "y", 24, 0), ("a", "k", "x", 25, 0), ("a", "old", "x", -9, 0)],  # 24 h later the key is fresh again
        [("a", "late", "x", 1, 0), ("a", "k", "y", 25, 1), ("b", "k", "z", 60, 0)],
        [("a", "k", "q", 59, 0), ("b", "k", "z", 61, 0), ("b", "k", "z", 49, 0)],
    )
    requests.start_dividing(stream, f"{path}/d", f"{path}/c1", "12 hours").awaitTermination()
    late = {(r.key, r.at, r.high_water) for r in requests.late(spark, f"{path}/d", stream.schema).collect()}
    hour = lambda h: T0 + timedelta(hours=h)
    # 2 is the mark the second file is compared with (-9 is 11 hours behind), 25 that of the third, 60 that of the fourth
    assert late == {("late", hour(1), hour(25))}
    for files in (1, 1000):
        out = requests.classified(requests.in_time(spark, f"{path}/d", stream.schema, files), "12 hours")
        windows.to_table(out, f"{path}/out{files}", f"{path}/c2{files}").awaitTermination()
        got = spark.read.schema(out.schema).parquet(f"{path}/out{files}").where("key = 'k'").orderBy("tenant_id", "batch", "at", "seq").collect()
        assert [(r.tenant_id, r.body_hash, r.outcome) for r in got] == [
            ("a", "x", "fresh"), ("a", "x", "replay"), ("a", "y", "conflict"), ("a", "y", "conflict"), ("a", "y", "fresh"), ("a", "x", "conflict"), ("a", "y", "replay"), ("a", "q", "fresh"),
            ("b", "y", "fresh"), ("b", "z", "fresh"), ("b", "z", "replay"), ("b", "z", "replay"),
        ]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    step = requests.divide(str(tmp_path), "at", "1 hour")
    rows = lambda *hours: spark.createDataFrame([("a", "k", "put", "x", T0 + timedelta(hours=h), 0) for h in hours], SCHEMA)
    step(rows(0, 10), 0)
    for _ in range(2):
        step(rows(2, 20), 1)
    schema = rows(0).schema
    assert requests.late(spark, str(tmp_path), schema).count() == 1
    assert spark.read.schema(schema).parquet(f"{tmp_path}/in_time").count() == 3


def test_forward_decay_is_exact(spark, tmp_path):
    path, landmark = str(tmp_path), "2024-01-01 00:00:00"
    kinds = ["citation", "correction", "no_op", "tool_success"]
    batches = [[("t", f"f{i % 3}", kinds[(i + b) % 4], T0 + timedelta(hours=7 * i + b)) for i in range(40)] for b in (5, 0, 2)]
    kind = "tenant_id string, fact_id string, event_kind string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{path}/e")
    stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/e")
    sums = windows.forward_decay(stream, landmark)
    windows.latest_sums(sums, f"{path}/s", f"{path}/c").awaitTermination()
    stored = spark.read.schema(sums.schema.add("batch", "long")).parquet(f"{path}/s")
    now = F.lit(T0 + timedelta(days=20))
    got = {r.fact_id: r.utility_raw for r in windows.decayed_at(upsert.latest(stored, ("tenant_id", "fact_id"), "batch"), landmark, now).collect()}
    want = {r.fact_id: r.utility_raw for r in ut.utility_raw(spark.createDataFrame(sum(batches, []), kind), now).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_a_key_with_one_request_asks_for_its_state_once():
    """Each call on the state is a message to another process, and sorting one row costs more than answering it."""
    from types import SimpleNamespace

    import pandas as pd

    from memspark.streaming import requests as rq

    calls = []
    state = SimpleNamespace(get=lambda: calls.append("get"), update=lambda x: calls.append("update"))
    handle = SimpleNamespace(getValueState=lambda *a: state, registerTimer=lambda t: calls.append("timer"), deleteTimer=None)
    step = rq._Conflicts(24)
    step.init(handle)
    row = pd.DataFrame({"body_hash": ["a"], "at": pd.to_datetime(["2024-01-01"]), "seq": [1]})
    row.sort_values = None
    out = list(step.handleInputRows(("t", "k", "v"), iter([row]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert out[0]["outcome"].tolist() == ["fresh"] and calls == ["get", "update", "timer"]
