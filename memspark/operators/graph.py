"""Ego graphs and connectedness over ``edges(src, dst, weight)``.

Out-edges are followed as stored.  Neighbours are visited in id order, so the cap of an ego
graph cuts at a defined place.

A hub may own a third of all edges.  Three things keep it harmless: neighbour lists are cut to
the cap before any join (a search that stops after ``cap`` nodes cannot read further), parents
behind one that fills the cap alone are not expanded, and edges that leave a hub are found from
their other end.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.session import broadcast_if, union_all

HUB_DEGREE = 4 * v.EGO_CAP  # above this a node's edges are reached from the other end
HUB_LIMIT = 200_000  # hub ids that may be broadcast
_CHUNK_ROWS = 200_000


def neighbour_lists(edges: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` neighbours of every node, by id; the cut happens before the shuffle."""
    w = Window.partitionBy("src").orderBy("dst")
    return (
        edges.select("src", "dst").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    )


def ego_nodes(edges: DataFrame, seeds: DataFrame, cap: int = v.EGO_CAP) -> DataFrame:
    """(seed, node, depth): breadth-first to depth 2, at most ``cap`` nodes with the seed."""
    if cap < 1:
        raise ValueError("cap must be at least 1")
    start = seeds.select("seed").distinct()
    adj = neighbour_lists(edges, cap)
    room = cap - 1
    out = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    if room == 0:
        return out

    per_seed = Window.partitionBy("seed")
    near = (
        start.join(adj, F.col("seed") == F.col("src")).where(F.col("dst") != F.col("seed"))
        .select("seed", F.col("dst").alias("node"))
        .withColumn("order", F.row_number().over(per_seed.orderBy("node"))).where(F.col("order") <= room)
    )
    degree = adj.groupBy("src").agg(F.count("*").alias("deg"))
    filled = F.min(F.when(F.col("deg") >= cap, F.col("order"))).over(per_seed)
    parents = (
        near.join(degree, F.col("node") == F.col("src"))
        .withColumn("_full", filled)
        .where(F.col("_full").isNull() | (F.col("order") <= F.col("_full")))
        .select("seed", F.col("node").alias("parent"), "order")
    )
    # one row per (seed, node): near nodes come first, far ones in the order of their first parent
    far = parents.join(adj, F.col("parent") == F.col("src")).where(F.col("dst") != F.col("seed")).select(
        "seed", F.col("dst").alias("node"), (F.col("order") + cap).cast("long").alias("key")
    )
    reached = (
        union_all(near.select("seed", "node", F.col("order").cast("long").alias("key")), far)
        .repartition("seed").groupBy("seed", "node").agg(F.min("key").alias("key"))
        .withColumn("_n", F.row_number().over(per_seed.orderBy("key", "node"))).where(F.col("_n") <= room)
    )
    return union_all(out, reached.select("seed", "node", F.when(F.col("key") <= cap, 1).otherwise(2).alias("depth")))


def ego_edges(edges: DataFrame, nodes: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(seed, src, dst, weight): stored edges with both ends inside the ego graph of the seed."""
    hubs = edges.groupBy("src").agg(F.count("*").alias("_d")).where(F.col("_d") > hub_degree).select("src")
    hubs = broadcast_if(hubs, HUB_LIMIT)
    plain, from_hub = edges.join(hubs, "src", "left_anti"), edges.join(hubs, "src", "left_semi")
    members = nodes.select("seed", "node")
    forward = members.join(plain, F.col("node") == F.col("src")).select("seed", "src", "dst", "weight").join(
        members.withColumnRenamed("node", "dst"), ["seed", "dst"], "left_semi"
    )
    backward = members.join(from_hub, F.col("node") == F.col("dst")).select("seed", "src", "dst", "weight").join(
        members.withColumnRenamed("node", "src"), ["seed", "src"], "left_semi"
    )
    return union_all(forward, backward).select("seed", "src", "dst", "weight")


def _pagerank(seed_of: np.ndarray, is_seed: np.ndarray, src, dst, w, n_seeds, damping, max_iter, tol) -> np.ndarray:
    """Personalised PageRank of many disjoint ego graphs at once; each stops on its own."""
    n = len(seed_of)
    out_w = np.bincount(src, weights=w, minlength=n)
    dangling = out_w == 0.0
    share = w / out_w[src]
    rank = is_seed.astype(np.float64)
    active = np.ones(n_seeds, dtype=bool)
    restart = np.flatnonzero(is_seed)
    for _ in range(max_iter):
        nxt = damping * np.bincount(dst, weights=rank[src] * share, minlength=n)
        lost = np.bincount(seed_of, weights=np.where(dangling, rank, 0.0), minlength=n_seeds)
        nxt[restart] += (1.0 - damping) + damping * lost[seed_of[restart]]
        moved = np.bincount(seed_of, weights=np.abs(nxt - rank), minlength=n_seeds)
        rank = np.where(active[seed_of], nxt, rank)
        active &= moved >= tol
        if not active.any():
            break
    return rank


def _connect(rows: pd.DataFrame, threshold: int, damping: float, max_iter: int, tol: float, digits: int) -> pd.DataFrame:
    """Rows (seed, src, dst, weight) of whole seeds; a row without dst only names a node."""
    seeds, names = pd.factorize(rows["seed"])
    m = len(rows)
    both = pd.concat([rows["src"], rows["dst"].where(rows["dst"].notna(), rows["src"])], ignore_index=True)
    code, labels = pd.factorize(both)
    width = len(labels)
    _, member = np.unique(np.concatenate([seeds, seeds]).astype(np.int64) * width + code, return_inverse=True)
    s_id, d_id = member[:m], member[m:]
    n, k = int(member.max()) + 1, len(names)
    seed_of = np.empty(n, dtype=np.int64)
    seed_of[s_id] = seeds
    label_of = np.empty(n, dtype=np.int64)
    label_of[s_id] = code[:m]
    label_of[d_id] = code[m:]
    seed_of[d_id] = seeds
    seed_label = pd.Index(labels).get_indexer(names)
    is_seed = label_of == seed_label[seed_of]
    size = np.bincount(seed_of, minlength=k)

    edge = rows["dst"].notna().to_numpy()
    weight = rows["weight"].to_numpy(dtype=np.float64)
    # degree ratio, over the stored edges
    deg = np.bincount(s_id[edge], minlength=n)
    own = np.zeros(k)
    own[seed_of[is_seed]] = deg[is_seed]
    best = own.copy()
    from_seed = edge & is_seed[s_id]
    np.maximum.at(best, seeds[from_seed], deg[d_id[from_seed]].astype(float))
    ratio = np.divide(own, best, out=np.zeros(k), where=best > 0)

    # mass percentile, over positive edges made symmetric
    use = edge & (weight > 0.0)
    es, ed, ew = s_id[use].astype(np.int64), d_id[use].astype(np.int64), weight[use]
    lone = ~np.isin(ed * n + es, es * n + ed)
    src, dst, w = np.concatenate([es, ed[lone]]), np.concatenate([ed, es[lone]]), np.concatenate([ew, ew[lone]])
    mass = np.round(_pagerank(seed_of, is_seed, src, dst, w, k, damping, max_iter, tol), digits)
    own_mass = np.zeros(k)
    own_mass[seed_of[is_seed]] = mass[is_seed]
    less = np.bincount(seed_of, weights=(mass < own_mass[seed_of]) & ~is_seed, minlength=k)
    pct = np.divide(less, size - 1, out=np.zeros(k), where=size > 1)
    return pd.DataFrame({
        "seed": names, "n_nodes": size, "connectedness": np.where(size < threshold, ratio, pct),
    })


def connectedness(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    cap: int = v.EGO_CAP,
    threshold: int = v.DEGREE_FALLBACK_BELOW,
    damping: float = v.PPR_DAMPING,
    max_iter: int = v.PPR_MAX_ITER,
    tol: float = v.PPR_TOL,
    digits: int = v.PPR_DIGITS,
) -> DataFrame:
    """(fact_id, n_nodes, connectedness) for ``seeds(seed)``.

    Below ``threshold`` nodes it is the degree ratio, else the share of the other ego nodes
    whose PageRank mass is smaller.  Spark brings each ego graph (at most ``cap`` nodes)
    together; numpy iterates over many of them per batch.
    """
    if not 0.0 < damping < 1.0 or max_iter < 1 or tol <= 0.0:
        raise ValueError("damping, max_iter or tol out of range")
    nodes = ego_nodes(edges, seeds, cap)
    inner = ego_edges(edges, nodes)
    rows = union_all(
        inner.select("seed", "src", "dst", F.col("weight").cast("double").alias("weight")),
        nodes.select(
            "seed", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"),
            F.lit(None).cast("double").alias("weight"),
        ),
    )

    def per_task(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            table = pa.Table.from_batches(held).to_pandas()
            held, count = [], 0
            if not last:  # the seed at the end may go on in the next batch
                tail = table["seed"] == table["seed"].iloc[-1]
                if tail.all():
                    held = [pa.RecordBatch.from_pandas(table, schema=schema, preserve_index=False)]
                    return None
                rest, table = table[tail], table[~tail]
                held = [pa.RecordBatch.from_pandas(rest, schema=schema, preserve_index=False)]
                count = len(rest)
            done = _connect(table, threshold, damping, max_iter, tol, digits)
            return pa.RecordBatch.from_pandas(done, schema=result, preserve_index=False)

        schema = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = batch.schema
            held.append(batch)
            count += batch.num_rows
            if count >= _CHUNK_ROWS:
                ready = flush(False)
                if ready is not None:
                    yield ready
        if held:
            yield flush(True)

    result = pa.schema([("seed", pa.string()), ("n_nodes", pa.int64()), ("connectedness", pa.float64())])
    return (
        rows.repartition("seed").sortWithinPartitions("seed")
        .mapInArrow(per_task, "seed string, n_nodes bigint, connectedness double")
        .withColumnRenamed("seed", "fact_id")
    )


def degree_ratio(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(fact_id, degree_ratio): own out-degree over the largest one among itself and its neighbours."""
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    reach = seeds.select(F.col("seed").alias("src")).distinct().join(edges.select("src", "dst"), "src")
    top = (
        reach.join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("_d")), "dst", "left")
        .groupBy("src").agg(F.max(F.coalesce("_d", F.lit(0))).alias("_near"))
    )
    return (
        seeds.select(F.col("seed").alias("src")).distinct().join(deg, "src", "left").join(top, "src", "left")
        .select(
            F.col("src").alias("fact_id"),
            F.when(F.coalesce("deg", F.lit(0)) == 0, F.lit(0.0))
            .otherwise(F.col("deg") / F.greatest("deg", "_near")).alias("degree_ratio"),
        )
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Positive edges plus the missing reverse ones, which take the forward weight."""
    kept = edges.where(F.col("weight") > 0.0).select("src", "dst", "weight")
    swapped = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return union_all(kept, swapped.join(kept, ["src", "dst"], "left_anti"))


def weighted_out_degree(edges: DataFrame, digits: int = v.RANK_DIGITS) -> DataFrame:
    return edges.groupBy("src").agg(F.round(F.sum("weight"), digits).alias("out_weight"), F.count("*").alias("out_degree"))
