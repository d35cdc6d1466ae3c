"""Exact nearest vectors that read only some cells of a stored clustering.

Vectors are stored by cell, the nearest of a few hundred centres; a cell keeps its radius.  By the triangle
inequality no vector of a cell is nearer to a query than the distance to the centre less the radius.  The
nearest cells of a query are searched first; the k-th distance found there rules out every cell whose bound is
larger, and the others are searched too.  The answer is that of ``knn.nearest``, whatever the centres are.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memspark import vocab as v
from memspark.operators import knn

FIT_ROWS = 20_000  # vectors the centres are fitted on: those with the smallest hashes of their ids
MOST_CELLS = 1024
_ROUNDS = 8
_SLACK = 1e-6  # radii and distances are rounded sums; a cell is left out only if it is clearly too far


@dataclass(frozen=True)
class Cells:
    """``vectors(cell, fact_id, scope, vec)`` stored by cell; ``table(cell, n, radius)``; ``centres``, one row per cell."""

    vectors: DataFrame
    table: DataFrame
    centres: np.ndarray
    dim: int


def _fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Centres of a few rounds of Lloyd's algorithm from evenly drawn rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(11)
    centres = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))]
    for _ in range(_ROUNDS):
        own = _nearest(sample, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(_gaps(rows[i : i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096))])


def build(vectors: DataFrame, path: str, *, dim: int, fact_col: str = "fact_id", vec_col: str = "vec", by: str | None = None, cells: int | None = None) -> Cells:
    """Store ``vectors`` by cell below ``path``.

    Centres are fitted on a sample of at most ``FIT_ROWS`` vectors, every vector is stored.  Null vectors are left out, one of
    another dimension fails the job.  A cell with most of the vectors is written as several files and read by several tasks.
    """
    spark = vectors.sparkSession
    rows = knn._typed(vectors, fact_col, vec_col, dim, "fact_id", by)
    drawn = rows.select("vec", F.xxhash64("fact_id", "scope").alias("h")).orderBy("h").limit(FIT_ROWS).select("vec").toPandas()
    sample = np.array(drawn["vec"].tolist(), dtype=np.float64).reshape(-1, dim)
    centres = _fit(sample, cells or min(MOST_CELLS, max(1, int(np.sqrt(rows.count())))))
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            m = knn._matrix(batch.column("vec"), dim)
            own = _nearest(m, sent.value)
            far = np.sqrt(((m - sent.value[own]) ** 2).sum(1))
            yield batch.append_column("cell", pa.array(own.astype(np.int32))).append_column("far", pa.array(far, pa.float64()))

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    spread = rows.mapInArrow(assign, schema).repartitionByRange("cell", F.xxhash64("fact_id"))
    spread.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(T.StructType([*(f for f in schema.fields if f.name != "cell"), schema["cell"]])).parquet(f"{path}/vectors")
    stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).write.mode("overwrite").parquet(f"{path}/cells")
    return Cells(stored.drop("far"), spark.read.parquet(f"{path}/cells"), centres, dim)


@dataclass(frozen=True)
class Near:
    """``hits`` as from ``knn.nearest``; ``work(query_id, cells, read)`` counts the cells there are and those searched for a query."""

    hits: DataFrame
    work: DataFrame


def nearest(stored: Cells, queries: DataFrame, k: int = v.FANOUT, *, query_col: str = "query_id", vec_col: str = "vec", digits: int = v.RANK_DIGITS, by: str | None = None, first: int = 2) -> Near:
    """The ``k`` nearest vectors of every query in its scope, ties broken by id.

    A batch of at most ``knn.QUERY_BLOCK`` queries is worked on; their bounds for all cells are one matrix on the driver (at
    most 4096 x 1024).  A larger batch is cut by hash into such batches, one after the other.  ``first`` cells are
    searched to find the distance that rules out others; a query that finds fewer than ``k`` rules out none.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    asked = knn._typed(queries, query_col, vec_col, stored.dim, "query_id", by)
    known = stored.table.orderBy("cell").toPandas()
    batch = asked.limit(knn.QUERY_BLOCK + 1).toPandas()
    if len(batch) > knn.QUERY_BLOCK:
        parts = -(-2 * asked.count() // knn.QUERY_BLOCK)
        found = [nearest(stored, queries.where(F.pmod(F.xxhash64(query_col), F.lit(parts)) == i), k, query_col=query_col, vec_col=vec_col, digits=digits, by=by, first=first) for i in range(parts)]
        hits, work = found[0].hits, found[0].work
        for f in found[1:]:
            hits, work = hits.union(f.hits), work.union(f.work)
        return Near(hits, work)
    schema = T.StructType([asked.schema["query_id"], stored.vectors.schema["fact_id"], T.StructField("distance", T.DoubleType())])
    names, scopes = batch["query_id"].tolist(), batch["scope"].tolist()
    matrix = np.array(batch["vec"].tolist(), dtype=np.float64).reshape(-1, stored.dim)
    cells = known["cell"].to_numpy(np.int64)
    gap = np.sqrt(np.maximum(_gaps(matrix, stored.centres[cells]), 0.0)) if len(cells) else np.zeros((len(names), 0))
    bound = np.maximum(gap - known["radius"].to_numpy(np.float64)[None, :], 0.0)
    rank = gap.argsort(1, kind="stable").argsort(1, kind="stable")
    near = rank < first
    ahead = knn._ranked(_scan(stored, near, cells, names, scopes, matrix, k, digits, schema), k)
    worst = dict(map(tuple, ahead.where(F.col("rank") == k).select("query_id", "distance").collect()))  # one number per query
    limit = np.array([worst.get(n, np.inf) for n in names]).reshape(-1, 1)
    open_ = near | (bound <= limit + _SLACK)
    hits = knn._ranked(_scan(stored, open_, cells, names, scopes, matrix, k, digits, schema), k)
    counts = [(n, len(cells), int(r)) for n, r in zip(names, open_.sum(1), strict=True)]
    return Near(hits, spark.createDataFrame(counts, T.StructType([schema["query_id"], T.StructField("cells", T.LongType()), T.StructField("read", T.LongType())])))


def _scan(stored: Cells, chosen: np.ndarray, cells: np.ndarray, names: list, scopes: list, matrix: np.ndarray, k: int, digits: int, schema: T.StructType) -> DataFrame:
    """Best rows per task and query, reading only cells that some query has chosen."""
    spark = stored.vectors.sparkSession
    wanted = {int(c): np.flatnonzero(chosen[:, i]) for i, c in enumerate(cells) if chosen[:, i].any()}
    if not wanted:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((wanted, np.array(scopes, dtype=object), matrix))
    arrow, columns, dim = [f.type for f in to_arrow_schema(schema)], schema.names, stored.dim

    def per_task(batches):
        of_cell, scope_of, queries = sent.value
        tops: dict[tuple, tuple] = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            coded = batch.column("scope").dictionary_encode()
            code, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            matrix_ = knn._matrix(batch.column("vec"), dim) if batch.num_rows else None
            for c in np.unique(cell):
                for s, scope in enumerate(values):
                    own = np.flatnonzero((cell == c) & (code == s))
                    if not len(own):
                        continue
                    key = (int(c), scope)
                    if key not in tops:
                        mine = of_cell[int(c)][scope_of[of_cell[int(c)]] == scope]
                        tops[key] = (mine, knn._TopK(queries[mine], k, digits) if len(mine) else None)
                    if tops[key][1] is not None:
                        ids = np.asarray(batch.column("fact_id").take(pa.array(own)).to_pylist(), dtype=object)
                        tops[key][1].add(ids, matrix_[own])
        for mine, top in tops.values():
            for q, (dist, ids) in zip(mine, top.best if top else [], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(ids), arrow[0]), pa.array(ids.tolist(), arrow[1]), pa.array(dist, pa.float64())], names=columns)

    return stored.vectors.where(F.col("cell").isin(list(wanted))).select("cell", "fact_id", "scope", "vec").mapInArrow(per_task, schema)
