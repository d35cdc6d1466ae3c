"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by random sign flips and fast Hadamard transforms; its hash is the coordinate
of largest absolute value with its sign.  A few hashes make a table's bucket; every vector also enters the
buckets its runner-up coordinates lead to (multiprobe).  Vectors that share a bucket are compared
by cosine in double precision.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import checkpointed
from memspark.operators.safety import components

_BLOCK = 512  # members of a bucket that meet in one comparison
_CELL = 4096  # rows of small buckets that share a task's group


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row (a power of two long), without scaling."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 1) -> np.ndarray:
    """Bucket numbers (row, table, probe) of unit vectors; a number names its table as well."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.hstack((x, np.zeros((n, width - d))))
    random = np.random.default_rng(seed + d)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * random.choice((-1.0, 1.0), width))
            order = np.argpartition(np.abs(y), width - 2, axis=1)[:, -2:]
            value = np.take_along_axis(y, order, 1)
            swap = np.abs(value[:, 0]) > np.abs(value[:, 1])
            order[swap], value[swap] = order[swap][:, ::-1], value[swap][:, ::-1]
            side = order * 2 + (value > 0)
            best.append(side[:, 1])
            second.append(side[:, 0])
            gap.append((np.abs(value[:, 1]) - np.abs(value[:, 0])) / np.maximum(np.abs(value[:, 1]), 1e-300))
        best, second, nearest = np.array(best), np.array(second), np.argsort(np.array(gap), 0, kind="stable")
        for p in range(probes):
            side = best.copy()
            if p:
                at = nearest[p - 1]
                side[at, np.arange(n)] = second[at, np.arange(n)]
            number = np.full(n, t, np.int64)
            for s in side:
                number = number * (2 * width) + s
            out[:, t, p] = number
    return out


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest bucket number that both rows of each pair hold (they hold one)."""
    out = np.full(len(a), -1, np.int64)
    left = np.arange(len(a))
    for t in range(a.shape[1]):
        x, y = a[left, t], b[left, t]
        same = (x[:, :, None] == y[:, None, :]).any(2)
        number = np.where(same, x, np.iinfo(np.int64).max).min(1)
        found = same.any(1)
        out[left[found]] = number[found]
        left = left[~found]
        if not len(left):
            break
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each row of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _comparer(threshold: float, shape: tuple[int, int]):
    def compare(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "cid", "copies")}
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float64).reshape(len(group), -1) if len(group) else np.empty((0, 1))
        held = np.frombuffer(b"".join(group.column("buckets").to_pylist()), np.int64).reshape(-1, *shape)
        order = np.lexsort((column["cid"], column["j"], column["i"], column["bucket"]))
        key = np.stack([column[c][order] for c in ("bucket", "i", "j")])
        starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        out_id, out_links, out_root = [], [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
            rows = order[lo:hi]
            if len(rows) < 2:
                continue
            near = x[rows] @ x[rows].T >= threshold
            np.fill_diagonal(near, False)
            i, j, bucket = (int(column[c][rows[0]]) for c in ("i", "j", "bucket"))
            if i != j:  # pairs inside a block belong to the comparison (i, i)
                block = column["block"][rows]
                near &= block[:, None] != block[None, :]
            if not near.any():
                continue
            a, b = np.nonzero(near)
            counted = _first_common(held[rows[a]], held[rows[b]]) == bucket
            links = np.bincount(a[counted], column["copies"][rows[b[counted]]], len(rows)).astype(np.int64)
            root = _roots(near)
            ids = column["cid"][rows]
            told = near.any(1)
            out_id.append(ids[told])
            out_links.append(links[told])
            out_root.append(ids[root][told])
        whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
        return pa.table({"cid": whole(out_id), "links": whole(out_links), "root": whole(out_root)})

    return compare


def _hasher(tables: int, hashes: int, probes: int):
    def hash_rows(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([vectors[k] for k in at], np.float64).reshape(len(at), d)
                # Scaling first keeps very large and very small components in range.
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                held = buckets(x, tables, hashes, probes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("cid").take(pa.array(at)), batch.column("copies").take(pa.array(at)), pa.array([int(d)] * len(at), pa.int32()),
                        pa.array([v.tobytes() for v in x], pa.binary()), pa.array([h.tobytes() for h in held], pa.binary()),
                        pa.array(list(held.reshape(len(at), -1)), pa.list_(pa.int64())),
                    ],
                    ["cid", "copies", "dim", "vector", "buckets", "held"],
                )

    return hash_rows


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, tables: int = 12, hashes: int | None = None, probes: int = 3
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Two rows are linked when the cosine of their vectors, in double precision, is ``threshold`` or
    more.  ``n_links`` counts the other rows linked to one directly, ``component_id`` is the smallest key that
    links lead to, ``kept`` tells whether that is the row's own key.  Null, empty and zero vectors and
    those with a null or non-finite component have no links, and vectors of different lengths none
    with each other.  Repeated rows are linked; null keys are left aside when the smallest is
    sought, and kept only where no key is known.  Other columns are ignored.

    Equal vectors are merged first and counted as often as they occur.  ``hashes`` per table follow
    the number of vectors (so that a bucket holds a few unrelated ones); buckets are cut into blocks
    that meet pairwise, so a large one spreads over many tasks.  A pair that meets in several buckets is counted
    in the first.  Every bucket is compared in full; the error is that of the hash (a pair at the threshold
    shares no bucket), measured in the tests.
    """
    x = F.col("x")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    rows = rows.withColumn("x", F.when(~bad, x))
    valid = rows.filter(x.isNotNull())
    classes = checkpointed(valid.groupBy("x").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("low")).select(F.monotonically_increasing_id().alias("cid"), "*"))
    if hashes is None:
        size = classes.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        hashes = max(1, math.ceil(math.log(max(2, size[0])) / math.log(2 * max(2, size[1] or 2))))
    hashed = classes.select("cid", "copies", x.alias("embedding")).mapInArrow(
        _hasher(tables, hashes, probes), "cid long, copies long, dim int, vector binary, buckets binary, held array<long>"
    )
    hashed = checkpointed(hashed)
    members = hashed.select("cid", "dim", F.explode("held").alias("bucket")).distinct()
    sizes = members.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / _BLOCK).cast("int"))
    total = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    met = members.join(sizes.select("dim", "bucket", "parts"), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("cid", "dim", "bucket", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    met = met.join(hashed.select("cid", "copies", "vector", "buckets"), "cid")
    cell = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, total // _CELL)))
    found = met.groupBy("dim", cell.alias("cell")).applyInArrow(_comparer(threshold, (tables, probes)), "cid long, links long, root long")
    found = checkpointed(found.groupBy("cid", "root").agg(F.sum("links").alias("links")))
    part = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "component")
    placed = classes.join(part, "cid", "left").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    placed = placed.select("x", "low", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = placed.join(lows, "component").select("x", "n_links", "component_id")
    linked = rows.join(placed, "x", "left")
    component = F.when(x.isNull(), F.col("key")).otherwise(F.col("component_id"))
    return linked.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept")
    )
