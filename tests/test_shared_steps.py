"""Queries that show one result in two ways work it out once; queries that group a graph's pairs share how they are dealt."""

import os
import re

import pytest
from pyspark.sql import functions as F

from memspark import catalog, session
from memspark.catalog.views import ORDER_KEYS, SUPPLY_KEYS, Views
from memspark.operators import bm25, lineage
from memspark.operators import utility as ut

DATA = f"{os.environ.get('MEMSPARK_TESTDATA', '/root/testdata')}/sf0.001"


@pytest.mark.parametrize("name,place,step", [("E2_lineage", lineage, "reach"), ("M5_probe_drift", bm25, "search_documents"), ("Q9_agreement", bm25, "search_documents")])
def test_the_costly_step_runs_once(spark, monkeypatch, name, place, step):
    calls, run = [], getattr(place, step)
    monkeypatch.setattr(place, step, lambda *a, **k: calls.append(1) or run(*a, **k))
    assert catalog.QUERIES[name](spark, DATA).count() > 0
    assert len(calls) == 1


def exchanges(df):
    """Partition counts of the shuffles that group or deal rows."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("graph,keys", [("supply_graph", SUPPLY_KEYS), ("dealt_order_graph", ORDER_KEYS)])
def test_pieces_of_a_graph_follow_its_rows(spark, monkeypatch, graph, keys):
    """More pieces than the 8 shuffle partitions that are set, and none much above its share."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    edges = getattr(Views(spark, DATA), graph)
    rows = edges.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert rows[0] >= 15 and rows[1] <= 2 * 1.5 * 100  # both directions of a pair
    cost = ut.cascade_cost(edges, 4, at=keys)
    assert sorted(exchanges(cost))[0] == 8 and len(exchanges(cost)) == 2  # the second brings the sums of a node together
    plain = ut.cascade_cost(edges.select("src", "dst", "weight"), 4)
    assert sorted(map(tuple, cost.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("name", ["F04_gravity", "A06_cascade_cost", "A07_cascade_p99", "F04_gravity_by_tenant"])
def test_pairs_are_grouped_in_pieces_sized_by_rows(spark, monkeypatch, name):
    before = sorted(map(repr, catalog.QUERIES[name](spark, DATA).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    got = catalog.QUERIES[name](spark, DATA)
    assert max(exchanges(got)) >= 15
    assert sorted(map(repr, got.collect())) == before


def test_pairs_of_the_supply_graph_are_shuffled_once(spark, monkeypatch):
    """One shuffle, sized by rows; the directions of a pair meet where they are made."""
    before = sorted(map(tuple, catalog.QUERIES["J08_undirected_edges"](spark, DATA).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    got = catalog.QUERIES["J08_undirected_edges"](spark, DATA)
    assert len(exchanges(got)) == 1 and exchanges(got)[0] >= 15
    assert sorted(map(tuple, got.collect())) == before
