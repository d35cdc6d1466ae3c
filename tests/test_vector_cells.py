"""Pruned exact search against the search over all vectors."""

import numpy as np
import pytest

from memspark.operators import knn, vector_cells

DIM = 6
SCHEMA = "tenant_id string, fact_id string, vec array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 5, (12, DIM))
    rows = [(f"t{i % 2}", f"f{i:05d}", (centres[i % 12] + rng.normal(0, 0.3, DIM)).tolist()) for i in range(1500)]
    rows += [("t0", f"same{i:03d}", [1.0] * DIM) for i in range(700)]  # a third of all rows in one place
    return spark.createDataFrame([*rows, ("t0", "none", None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(4)
    rows = [(f"q{i}", f"t{i % 2}", rng.normal(0, 4, DIM).tolist()) for i in range(25)]
    return spark.createDataFrame([*rows, ("same", "t0", [1.0] * DIM), ("nobody", "t9", [0.0] * DIM), ("null", "t0", None)], "query_id string, tenant_id string, vec array<double>")


@pytest.fixture(scope="module")
def stored(vectors, tmp_path_factory):
    return vector_cells.build(vectors, f"{tmp_path_factory.mktemp('cells')}/v", dim=DIM, by="tenant_id", cells=20)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [1, 7, 60, 3000])
def test_cells_are_exact(stored, vectors, asked, k):
    got = vector_cells.nearest(stored, asked, k, by="tenant_id")
    assert rows(got.hits) == rows(knn.nearest(vectors, asked, k, dim=DIM, by="tenant_id"))


def test_cells_are_left_out_and_counted(stored, asked):
    work = {r.query_id: r for r in vector_cells.nearest(stored, asked, 5, by="tenant_id").work.collect()}
    assert "null" not in work and work["nobody"].read == work["nobody"].cells
    near = [r for q, r in work.items() if q != "nobody"]
    assert sum(r.read for r in near) < 0.5 * sum(r.cells for r in near)


def test_large_batches_are_cut(monkeypatch, stored, vectors, asked):
    want = rows(knn.nearest(vectors, asked, 4, dim=DIM, by="tenant_id"))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    assert rows(vector_cells.nearest(stored, asked, 4, by="tenant_id").hits) == want


def test_without_scope_and_without_rows(spark, tmp_path, vectors, asked):
    flat = vector_cells.build(vectors, f"{tmp_path}/a", dim=DIM, cells=5)
    assert rows(vector_cells.nearest(flat, asked, 3).hits) == rows(knn.nearest(vectors, asked, 3, dim=DIM))
    assert vector_cells.nearest(flat, asked.limit(0), 3).hits.count() == 0
    none = vector_cells.build(vectors.limit(0), f"{tmp_path}/b", dim=DIM)
    assert vector_cells.nearest(none, asked, 3).hits.count() == 0


def test_wrong_dimension_fails(spark, tmp_path):
    bad = spark.createDataFrame([("t", "f", [1.0])], SCHEMA)
    with pytest.raises(Exception, match="dimension"):
        vector_cells.build(bad, f"{tmp_path}/v", dim=DIM)


def test_other_cells_are_not_scanned(stored, asked):
    one = asked.where("query_id = 'same'")
    plan = vector_cells.nearest(stored, one, 5, by="tenant_id").hits._jdf.queryExecution().executedPlan().toString()
    read = vector_cells.nearest(stored, one, 5, by="tenant_id").work.first().read
    assert read < 20 and "PartitionFilters: [cell" in plan
