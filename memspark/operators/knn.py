"""Exact k nearest vectors (L2) for a batch of query vectors.

The vectors are read once and stay where they are: each task keeps the k best rows per
query while it streams its Arrow batches, so the only shuffle carries k rows per query and
task.  The query batch travels as one numpy matrix when its row count is small enough;
a larger batch is cut into blocks and both sides meet in a block grid by a shuffled
co-group.  Both ways are exact and give the same rows.

``by`` names a column both sides share, such as ``tenant_id``: a query meets only vectors that agree
in it.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memspark import vocab as v
from memspark.functions.common import fail_when

QUERY_BLOCK = 4096  # queries per block, 2 MiB at 64 dimensions
VECTOR_CHUNK = 100_000  # vectors per grid cell
_CELLS = 4_000_000  # distances held at once inside a task


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, dist))[:k]
    return dist[order], ids[order]


class _TopK:
    """k best (distance, id) per query, fed with blocks of vectors."""

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self.q, self.k, self.scale = queries, k, 10.0**digits
        self.qq = (queries * queries).sum(axis=1)
        self.best = [(np.empty(0), np.empty(0, dtype=object)) for _ in range(len(queries))]

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        step = max(1, _CELLS // max(1, len(self.q)))
        for lo in range(0, len(ids), step):
            self._add(ids[lo : lo + step], vecs[lo : lo + step])

    def _add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        sq = (vecs * vecs).sum(axis=1)
        approx = self.qq[:, None] + sq[None, :] - 2.0 * (self.q @ vecs.T)
        # the product form loses digits to cancellation; what it screens out is certain to
        # be worse, what it keeps is measured again from the differences
        slack = 1e-9 * (1.0 + self.qq[:, None] + sq[None, :].max(initial=0.0))
        kth = min(self.k, approx.shape[1]) - 1
        bound = np.partition(approx, kth, axis=1)[:, kth]
        for i in range(len(self.q)):
            limit = bound[i]
            have = self.best[i][0]
            if len(have) == self.k:
                limit = min(limit, have[-1] ** 2)
            pick = np.flatnonzero(approx[i] <= limit + 2.0 * slack[i])
            if len(pick) == 0:
                continue
            gap = vecs[pick] - self.q[i]
            dist = np.rint(np.sqrt((gap * gap).sum(axis=1)) * self.scale) / self.scale
            self.best[i] = _best(np.concatenate([have, dist]), np.concatenate([self.best[i][1], ids[pick]]), self.k)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if isinstance(
        column, pa.ChunkedArray
    ) else column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, dim)


def _typed(df: DataFrame, id_col: str, vec_col: str, dim: int, name: str, by: str | None) -> DataFrame:
    """(id, scope, vec) with the dimension enforced and missing vectors left out."""
    vec = F.col(vec_col)
    bad = F.size(vec) != dim
    message = F.concat(F.lit("vector dimension "), F.size(vec).cast("string"), F.lit(f" is not {dim}"))
    return df.where(vec.isNotNull()).select(
        F.col(id_col).alias(name), (F.col(by) if by else F.lit("")).cast("string").alias("scope"),
        fail_when(bad, message, vec).cast("array<double>").alias("vec"),
    )


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "fact_id")
    return (
        hits.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(
            "query_id", "fact_id", "distance",
            (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("score"),
            F.lit("semantic").alias("source"), "rank",
        )
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = v.FANOUT,
    *,
    dim: int,
    fact_col: str = "fact_id",
    query_col: str = "query_id",
    vec_col: str = "vec",
    digits: int = v.RANK_DIGITS,
    query_block: int = QUERY_BLOCK,
    vector_chunk: int = VECTOR_CHUNK,
    by: str | None = None,
) -> DataFrame:
    """(query_id, fact_id, distance, score, source, rank), ties broken by fact_id."""
    if k <= 0:
        raise ValueError("k must be positive")
    vecs = _typed(vectors, fact_col, vec_col, dim, "fact_id", by)
    qs = _typed(queries, query_col, vec_col, dim, "query_id", by)
    schema = T.StructType([
        qs.schema["query_id"], vecs.schema["fact_id"], T.StructField("distance", T.DoubleType()),
    ])
    batch = qs.limit(query_block + 1).toPandas()  # never more than one block comes to the driver
    if len(batch) <= query_block:
        found = _screen_with_matrix(vecs, batch, k, dim, digits, schema)
    else:
        found = _screen_on_grid(vecs, qs, k, dim, digits, schema, query_block, vector_chunk)
    return _ranked(found, k)


def _screen_with_matrix(vecs, rows: pd.DataFrame, k, dim, digits, schema) -> DataFrame:
    """The whole query batch fits one block: it is sent to every task."""
    if rows.empty:
        return vecs.sparkSession.createDataFrame([], schema)
    scopes = {
        scope: (part["query_id"].tolist(), np.array(part["vec"].tolist(), dtype=np.float64).reshape(-1, dim))
        for scope, part in rows.groupby("scope", dropna=True)
    }
    sent = vecs.sparkSession.sparkContext.broadcast(scopes)

    def per_task(batches):
        asked = sent.value
        tops = {scope: _TopK(q, k, digits) for scope, (_, q) in asked.items()}
        for batch in batches:
            scope = np.asarray(batch.column("scope").to_pylist(), dtype=object)
            ids = np.asarray(batch.column("fact_id").to_pylist(), dtype=object)
            matrix = _matrix(batch.column("vec"), dim) if batch.num_rows else None
            for s in set(scope) & set(tops):
                own = scope == s
                tops[s].add(ids[own], matrix[own])
        for name, (dist, ids) in ((n, b) for s, top in tops.items() for n, b in zip(asked[s][0], top.best)):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(ids), type=arrow_types[0]),
                        pa.array(ids.tolist(), type=arrow_types[1]),
                        pa.array(dist, type=pa.float64()),
                    ],
                    names=["query_id", "fact_id", "distance"],
                )

    arrow_types = [f.type for f in to_arrow_schema(schema)]
    return vecs.mapInArrow(per_task, schema)


def _screen_on_grid(vecs, qs, k, dim, digits, schema, query_block, vector_chunk) -> DataFrame:
    """Every query block meets every vector chunk in one grid cell of bounded size."""
    sizes = qs.agg(F.count("*").alias("n")).first()["n"], vecs.agg(F.count("*").alias("n")).first()["n"]
    n_blocks = max(1, -(-sizes[0] // query_block))
    n_chunks = max(1, -(-sizes[1] // vector_chunk))

    def bucket(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    left = vecs.select(
        "fact_id", "scope", "vec", bucket("fact_id", n_chunks).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    right = qs.select(
        "query_id", "scope", "vec", bucket("query_id", n_blocks).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"),
    )

    def cell(vec_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vec_rows) and len(query_rows):
            q = np.stack(query_rows["vec"].to_numpy()).astype(np.float64)
            top = _TopK(q, k, digits)
            top.add(vec_rows["fact_id"].to_numpy(dtype=object), np.stack(vec_rows["vec"].to_numpy()).astype(np.float64))
            for name, (dist, ids) in zip(query_rows["query_id"], top.best):
                out.append(pd.DataFrame({"query_id": name, "fact_id": ids, "distance": dist}))
        empty = pd.DataFrame({"query_id": [], "fact_id": [], "distance": []})
        return pd.concat(out, ignore_index=True) if out else empty

    keys = ("scope", "block", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)


def checked_vectors(rows: DataFrame, dim: int, strict: bool = True) -> DataFrame:
    """Rows fit for the vector store: right dimension, exactly one of the three keys set."""
    n_keys = sum((F.col(c).isNotNull().cast("int") for c in ("node_id", "edge_id", "episode_id")), F.lit(0))
    ok = (F.size("embedding") == dim) & (n_keys == 1)
    if not strict:
        return rows.where(ok)
    return rows.withColumn("embedding", fail_when(~ok, "vector row needs its dimension and one key", F.col("embedding")))


def join_keys(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors with their node id; rows keyed by an edge or an episode are not searchable facts."""
    return (
        vectors.join(keys, "rowid").where(F.col("node_id").isNotNull())
        .select(F.col("node_id").alias("fact_id"), F.col("embedding").alias("vec"))
    )
