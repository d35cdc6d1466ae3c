"""Places and running sums against plain sorting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memspark.operators import percentiles, positions


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    hot = [("hot", rng.randint(0, 5000)) for _ in range(3000)]
    return hot + [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(900)] + [("one", 1)]


def frame(spark, rows):
    return spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v long, i long").repartition(6)


def groups(rows):
    out = defaultdict(list)
    for i, (g, v) in enumerate(rows):
        out[g].append((v is not None, v or 0, i))
    return {g: sorted(x) for g, x in out.items()}


@pytest.mark.parametrize("n_ranges", [1, 7])
def test_positions(spark, rows, n_ranges):
    got = positions.positions(frame(spark, rows), ("g",), [F.asc_nulls_first("v"), F.col("i")], n_ranges).collect()
    want = {i: (g, k, len(x)) for g, x in groups(rows).items() for k, (_, _, i) in enumerate(x)}
    assert len(got) == len(rows) and all((r.g, r.pos, r.n) == want[r.i] for r in got)


@pytest.mark.parametrize("n_ranges", [1, 7])
def test_running_sum(spark, rows, n_ranges):
    got = positions.running_sum(frame(spark, rows), "i", ("g",), [F.asc_nulls_first("v"), F.col("i")], "up", n_ranges).collect()
    want = {}
    for x in groups(rows).values():
        total = 0
        for _, _, i in x:
            want[i] = total
            total += i
    assert len(got) == len(rows) and all(r.up == want[r.i] for r in got)


def test_without_groups_and_without_rows(spark, rows):
    got = positions.positions(frame(spark, rows), (), [F.col("i")], 5)
    assert got.filter("pos <> i or n <> 3901").isEmpty() and got.count() == 3901
    assert positions.positions(frame(spark, rows).limit(0), ("g",), [F.col("i")]).count() == 0


def test_no_range_holds_a_large_group(spark):
    """A third of all rows in one group is dealt over the ranges."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 1000)).alias("g"), F.col("id").alias("v"))
    placed = positions.ranges(rows.repartition(8), ("g",), [F.col("v")], 30)
    assert placed.groupBy("_part").count().agg(F.max("count")).first()[0] < 6000
    assert placed.where("g = 'hot'").select("_part").distinct().count() >= 8


def test_rank_among_others(spark, rows):
    got = percentiles.rank_among_others(frame(spark, rows).where("g is not null and v is not null"), "v", ("g",), n_ranges=7).collect()
    values = defaultdict(list)
    for g, v in rows:
        if g is not None and v is not None:
            values[g].append(v)
    assert got and all(r.pct_rank == pytest.approx(sum(x < r.v for x in values[r.g]) / (len(values[r.g]) - 1) if len(values[r.g]) > 1 else 0.0) for r in got)


def test_percentile_points(spark, rows):
    """Several points of all groups, null group and null values included, against sorted lists."""
    points = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = {r.g: r for r in percentiles.percentile_points(frame(spark, rows), "v", points, ("g",), n_ranges=7).collect()}
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(v)
    assert set(got) == set(values)
    for g, vs in values.items():
        vs.sort()
        assert got[g].n == len(vs) and all(got[g][name] == vs[percentiles.disc_index(p, len(vs))] for name, p in points.items())
    assert percentiles.percentile_points(frame(spark, rows).limit(0), "v", points, ("g",)).count() == 0
    whole = percentiles.percentile_points(frame(spark, rows), "v", {"m": 0.5}).first()
    every = sorted(v for _, v in rows if v is not None)
    assert (whole.n, whole.m) == (len(every), every[percentiles.disc_index(0.5, len(every))])
    with pytest.raises(ValueError):
        percentiles.percentile_points(frame(spark, rows), "v", {"p": 0.0})
