"""Closures over chains, diamonds and circles."""

import random
from collections import defaultdict

import pytest

from memspark.operators import lineage

EDGES = "tenant_id string, src string, dst string"


def plain(starts, edges):
    """Breadth-first search from every start: {(tenant, start, node): depth}."""
    out = defaultdict(set)
    for t, a, b in edges:
        out[t, a].add(b)
    found = {}
    for t, s, n in starts:
        layer, depth = {n}, 0
        while layer:
            for x in layer:
                found[t, s, x] = min(depth, found.get((t, s, x), depth))
            layer, depth = {y for x in layer for y in out[t, x] if (t, s, y) not in found}, depth + 1
    return found


CASES = {
    "chain": [("t", f"n{i}", f"n{i + 1}") for i in range(14)],
    "diamonds": [("t", f"a{i}", f"{x}{i}") for i in range(4) for x in "bc"] + [("t", f"{x}{i}", f"a{i + 1}") for i in range(4) for x in "bc"],
    "circle": [("t", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)] + [("t", "n0", "n0"), ("t", "n0", "n1"), ("t", None, "n1"), ("t", "n1", None), ("u", "n0", "x")],
    "random": [(random.Random(i).choice("tu"), f"n{random.Random(i).randint(0, 25)}", f"n{random.Random(i + 999).randint(0, 25)}") for i in range(70)],
}


@pytest.mark.parametrize("name", CASES)
def test_reach(spark, name):
    edges = CASES[name]
    starts = sorted({(t, a, a) for t, a, _ in edges if a})[:12]
    got = lineage.reach(spark.createDataFrame(starts, "tenant_id string, start string, node string"), spark.createDataFrame(edges, EDGES)).collect()
    want = plain(starts, [e for e in edges if None not in e])
    assert len(got) == len(want) and {(r.tenant_id, r.start, r.node): r.depth for r in got} == want


def test_lineage_and_parts(spark):
    merges = spark.createDataFrame([("t", "a", "m"), ("t", "b", "m"), ("t", "m", "top"), ("t", "c", "top"), ("t", "top", "m"), ("u", "z", "m")], "tenant_id string, fact_id string, merged_id string")
    provenance = spark.createDataFrame([("t", f, f"e-{f}") for f in ("a", "b", "c", "m")] + [("u", "z", "e-z"), ("t", "z", "no")], "tenant_id string, fact_id string, episode_id string")
    parts = {(r.tenant_id, r.merged_id, r.fact_id) for r in lineage.all_parts(merges).collect()}
    assert ("t", "m", "m") not in parts and ("t", "top", "a") in parts and ("u", "m", "z") in parts and ("t", "m", "z") not in parts
    got = {tuple(r) for r in lineage.lineage(merges, provenance).collect()}
    assert got == {("t", m, f"e-{f}") for m in ("m", "top") for f in ("a", "b", "c", "m")} | {("u", "m", "e-z")}


def test_cascade_is_refused_as_a_whole(spark):
    facts = spark.createDataFrame([("t", "f1", "e1"), ("t", "f9", "e2"), ("t", "free", "e3")], "tenant_id string, fact_id string, episode_id string")
    derived = spark.createDataFrame([("t", "f1", "f2"), ("t", "f2", "f3"), ("t", "f1", "f3"), ("t", "f3", "f1"), ("u", "f9", "f1")], EDGES)
    episodes = facts.select("tenant_id", "episode_id").where("episode_id <> 'e3'")
    got = {tuple(r) for r in lineage.cascade(facts, derived, episodes, 2).collect()}
    bad, fine = "precondition_failed", "intended_not_applied"
    assert got == {("t", "e1", "f1", 0, 3, bad), ("t", "e1", "f2", 1, 3, bad), ("t", "e1", "f3", 1, 3, bad), ("t", "e2", "f9", 0, 1, fine)}
    assert lineage.cascade(facts.limit(0), derived, episodes, 2).count() == 0
