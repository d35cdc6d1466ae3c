import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from memspark.operators import graph, percentiles, safety
from memspark.operators import utility as ut


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src string, dst string, weight double")


def adjacency(edges):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, {})[b] = w
    return adj


def bfs(adj, seed, cap):
    """Breadth-first to depth two, neighbours in id order, stopping at cap nodes."""
    if seed not in adj:
        return {seed}
    seen, todo = {seed}, deque([(seed, 0)])
    while todo and len(seen) < cap:
        node, depth = todo.popleft()
        if depth == 2:
            continue
        for n in sorted(adj.get(node, {})):
            if n not in seen:
                seen.add(n)
                if len(seen) >= cap:
                    break
                todo.append((n, depth + 1))
    return seen


def plain_connectedness(adj, seed, cap=500):
    nodes = bfs(adj, seed, cap)
    if len(nodes) < 10:
        own = len(adj.get(seed, {}))
        best = max([own] + [len(adj.get(n, {})) for n in adj.get(seed, {})])
        return own / best if own else 0.0
    sub = {n: {m: w for m, w in adj.get(n, {}).items() if m in nodes and w > 0} for n in nodes}
    for n in nodes:
        for m, w in list(sub[n].items()):
            sub[m].setdefault(n, w)
    rank = {n: float(n == seed) for n in nodes}
    for _ in range(50):
        nxt = dict.fromkeys(nodes, 0.0)
        lost = 0.0
        for n in nodes:
            total = sum(sub[n].values())
            if total == 0:
                lost += rank[n]
            for m, w in sub[n].items():
                nxt[m] += 0.85 * rank[n] * w / total
        nxt[seed] += 0.15 + 0.85 * lost
        moved = sum(abs(nxt[n] - rank[n]) for n in nodes)
        rank = nxt
        if moved < 1e-6:
            break
    own = round(rank[seed], 12)
    others = [round(x, 12) for n, x in rank.items() if n != seed]
    return sum(x < own for x in others) / len(others)


def random_edges(seed, nodes, count):
    rng = random.Random(seed)
    out = {}
    for _ in range(count):
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        out[(f"n{a:03d}", f"n{b:03d}")] = rng.choice([0.0, 0.5, 1.0, 2.0])
    for i in range(nodes):  # one hub in a third of all edges
        out[("n000", f"n{i:03d}")] = 1.0
        if i % 2:
            out[(f"n{i:03d}", "n000")] = 1.0
    return [(a, b, w) for (a, b), w in out.items()]


@pytest.mark.parametrize("cap", [1, 2, 7, 25, 500])
def test_ego_nodes_stop_where_a_search_stops(spark, cap):
    edges = random_edges(5, 60, 150)
    adj = adjacency(edges)
    seeds = sorted({a for a, _, _ in edges} | {"missing"})
    got = {}
    for r in graph.ego_nodes(frame(spark, edges), spark.createDataFrame([(s,) for s in seeds], "seed string"), cap).collect():
        got.setdefault(r.seed, set()).add(r.node)
    assert got == {s: bfs(adj, s, cap) for s in seeds}


def test_ego_edges_of_hubs_from_the_other_end(spark):
    edges = random_edges(6, 40, 120)
    e = frame(spark, edges)
    nodes = graph.ego_nodes(e, e.select(F.col("src").alias("seed")), 12)
    plain = sorted(map(tuple, graph.ego_edges(e, nodes).collect()))
    assert sorted(map(tuple, graph.ego_edges(e, nodes, hub_degree=3).collect())) == plain
    adj = adjacency(edges)
    want = sorted(
        (s, a, b, float(w)) for s in adj for nodes_ in [bfs(adj, s, 12)] for a, b, w in edges if a in nodes_ and b in nodes_
    )
    assert plain == want


@pytest.mark.parametrize("cap", [500, 15])
def test_connectedness_equals_the_plain_walk(spark, monkeypatch, cap):
    monkeypatch.setattr(graph, "_CHUNK_ROWS", 50)  # many chunks, cut at seed borders
    edges = random_edges(7, 50, 90) + [("x1", "x2", 1.0), ("x2", "x1", 1.0), ("y1", "y2", 1.0)]
    adj = adjacency(edges)
    seeds = [(s,) for s in [*adj, "missing", "y2"]]
    got = dict(
        graph.connectedness(frame(spark, edges), spark.createDataFrame(seeds, "seed string"), cap=cap)
        .select("fact_id", "connectedness").collect()
    )
    assert got == pytest.approx({s: plain_connectedness(adj, s, cap) for (s,) in seeds}, abs=1e-9)


def test_star_and_ring(spark):
    star = [("c", f"l{i:02d}", 1.0) for i in range(12)] + [(f"l{i:02d}", "c", 1.0) for i in range(12)]
    got = dict(graph.connectedness(frame(spark, star), spark.createDataFrame([("c",), ("l03",)], "seed string"))
               .select("fact_id", "connectedness").collect())
    assert got["c"] == 1.0 and got["l03"] == pytest.approx(11 / 12)


def test_percentile_rule(spark):
    rng = random.Random(2)
    for n in (1, 10, 99, 100, 101, 1000):
        vals = [rng.choice([0.0, 1.0, rng.random() * 9]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in vals], "x double")
        for p in (0.5, 0.95, 0.99, 1.0):
            assert percentiles.percentile_disc(df, "x", p).first()["pct"] == sorted(vals)[percentiles.disc_index(p, n)]
    assert percentiles.percentile_disc(df.where("x > 100"), "x", 0.99).count() == 0


def test_percentile_survives_a_bad_bracket(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "ACCURACY", 1)  # the sketch knows next to nothing
    vals = [(g, float(i * 7919 % 1000)) for g in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(vals, "g string, x double")
    for p in (0.1, 0.9):
        for r in percentiles.percentile_disc(df, "x", p, ("g",)).collect():
            xs = sorted(x for g, x in vals if g == r.g)
            assert r.pct == xs[percentiles.disc_index(p, 400)]


def test_cascade_cost(spark):
    e = frame(spark, [("a", "b", 2), ("b", "a", 2), ("b", "c", 3), ("c", "c", 9)])
    assert dict(ut.cascade_cost(e).collect()) == {"a": 2.0, "b": 5.0, "c": 3.0}
    with pytest.raises(Exception, match="differ"):
        ut.cascade_cost(frame(spark, [("a", "b", 2), ("b", "a", 3)])).collect()
    with pytest.raises(Exception, match="negative"):
        ut.cascade_cost(frame(spark, [("a", "b", -1)])).collect()
    g = {r.fact_id: r for r in ut.with_gravity(ut.cascade_cost(e)).collect()}
    assert g["b"].gravity == 1.0 and g["b"].p99 == 5.0 and g["a"].gravity == pytest.approx(0.4)
    empty = spark.createDataFrame([], "fact_id string, cascade_cost double")
    assert ut.with_gravity(empty).count() == 0


def test_utility_window_and_clip(spark, ts):
    now = ts("2024-03-01 00:00:00")
    data = [
        ("t", "a", "citation", ts("2024-03-01 00:00:00")), ("t", "a", "correction", ts("2024-01-31 00:00:00")),  # both ends
        ("t", "a", "correction", ts("2024-01-30 23:59:59")), ("t", "a", "correction", ts("2024-03-01 00:00:01")),
        ("t", "b", "no_op", ts("2024-02-29 00:00:00")),
    ]
    ev = spark.createDataFrame(data, "tenant_id string, fact_id string, event_kind string, ts timestamp")
    import math

    raw = {r.fact_id: r.utility_raw for r in ut.utility_raw(ev, F.lit(now)).collect()}
    assert raw["a"] == pytest.approx(0.4 + math.exp(-1)) and raw["b"] < 0
    got = {r.fact_id: r.utility for r in ut.utility(ev, F.lit(now)).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    bad = spark.createDataFrame([("t", "a", "odd", now)], ev.schema)
    with pytest.raises(Exception, match="unknown utility event"):
        ut.utility_raw(bad, F.lit(now)).collect()


def test_frozen_and_late_utility_events(spark, ts):
    ev = spark.createDataFrame(
        [("t", "a", "citation", ts("2024-01-02 00:00:00"), False), ("t", "a", "citation", ts("2024-01-05 00:00:00"), False),
         ("t", "a", "citation", ts("2024-01-01 00:00:00"), True), ("t", "x", "citation", ts("2024-01-09 00:00:00"), False)],
        "tenant_id string, fact_id string, event_kind string, ts timestamp, frozen boolean")
    facts = spark.createDataFrame([("t", "a", ts("2024-01-05 00:00:00"))], "tenant_id string, fact_id string, valid_to timestamp")
    assert ut.live_events(ev, facts).count() == 2


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    pairs += [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {}
    for x in list(parent):
        want[x] = find(x)
    got = dict(safety.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == want
