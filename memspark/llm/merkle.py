"""Merkle manifest of a dataset.

Rows are leaves; every ``ARITY`` neighbours become one parent, until one node is left for each group and
then one for the dataset.  A level of an aligned block of leaves is kept as one string of hex digests:
parents are hashes of its fixed-width substrings, the siblings of a node are the two substrings beside it
in its run.  Blocks of one round are the leaves of the next, and the roots of groups are the leaves of a
last tree over the groups.  Built-in functions only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import checkpointed
from memspark.session import broadcast_if

ARITY = 16
_HEX = 64  # characters of a digest
_RUN = ARITY * _HEX
_HEIGHT = 2  # levels of a block: 256 leaves, 16 KB of digests
_BLOCK = ARITY**_HEIGHT
_BROADCAST_ROWS = 200_000  # rows of the offset table (group and partition) sent to every task


def leaf(*columns: str | Column) -> Column:
    """Digest of a row: each field as byte count, colon and value, a null field as ``-``."""
    out = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        out.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*out), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf digest and the siblings of its path lead to."""
    return F.aggregate(proof, node, lambda at, s: F.sha2(F.concat(s["left"], F.encode(at, "UTF-8"), s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(proof, F.lit(b""), lambda at, s: F.concat(at, s["left"], s["right"])), 256)


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` (place in its group ``g``, from 0) and ``n`` (size of the group).

    Nodes are sorted by ranges, so a group of any size is spread over many tasks; places are the row's
    number in its partition behind what earlier partitions hold of the group.
    """
    by = [F.asc_nulls_first(c) for c in ("g", *order)]
    sort = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    sort = checkpointed(sort.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    counts = sort.groupBy("g", "part").agg(F.count(F.lit(1)).alias("here"), F.min("row").alias("first"))
    of_group = Window.partitionBy("g")
    before = F.sum("here").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(of_group).alias("n"))
    return sort.join(broadcast_if(counts, _BROADCAST_ROWS), ["g", "part"]).withColumn("pos", F.col("row") + F.col("shift"))


def _levels(n: Column) -> Column:
    """Levels a block of a group of ``n`` nodes has above its own: one node must be left, not fewer levels."""
    out = F.lit(_HEIGHT)
    for k in range(_HEIGHT - 1, -1, -1):
        out = F.when(n <= ARITY**k, F.lit(k)).otherwise(out)
    return out


def _bottom(members: Column) -> Column:
    return F.encode(F.array_join(F.transform(members, lambda m: m["node"]), ""), "UTF-8")


def _parents(level: Column) -> Column:
    """The level above: one digest for each run of siblings."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / _RUN).cast("int") - 1)
    return F.encode(F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * _RUN + 1, F.lit(_RUN)), 256)), ""), "UTF-8")


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, bottom up, and the node left in each group.

    ``nodes(g, pos, n, node, more)``; a round divides the number of nodes by the block size.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    more = nodes.schema["more"].dataType
    frames = []
    while True:
        blocks = nodes.groupBy("g", F.floor(F.col("pos") / _BLOCK).cast("long").alias("block")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", "more"))).alias("members")
        )
        blocks = blocks.withColumn("high", _levels(F.col("n"))).withColumn("level0", _bottom(F.col("members")))
        for k in range(1, _HEIGHT + 1):
            blocks = blocks.withColumn(f"level{k}", F.when(F.col("high") >= k, _parents(F.col(f"level{k - 1}"))))
        top = F.coalesce(*(F.col(f"level{k}") for k in range(_HEIGHT, -1, -1)))
        blocks = checkpointed(blocks.withColumn("top", F.decode(top, "UTF-8")).drop("level0", f"level{_HEIGHT}"))
        frames.append(blocks)
        nodes = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / _BLOCK).alias("n"), F.col("top").alias("node"), F.lit(None).cast(more).alias("more"))
        most = -(-most // _BLOCK)
        if most <= 1:
            return frames, nodes


def _beside(i: Column) -> Column:
    """Siblings of member ``i`` of a block, from its own level to the top of the block."""
    found = []
    for k in range(_HEIGHT):
        at = F.floor(i / ARITY**k).cast("int")
        run = F.floor(at / ARITY).cast("int")
        level = F.col(f"level{k}")
        left = F.substring(level, run * _RUN + 1, (at - run * ARITY) * _HEX)
        right = F.substring(level, (at + 1) * _HEX + 1, ((run + 1) * ARITY - at - 1) * _HEX)
        found.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*found), F.lit(1), F.col("high"))


def _descend(frames: list[DataFrame], above: DataFrame) -> DataFrame:
    """``g, node, more, proof, subroot, root`` of every node of the lowest round; ``above(g, proof, subroot, root)``."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(frames):
        met = blocks.join(above, ["g", "block"]).withColumn("level0", _bottom(F.col("members")))
        each = F.explode(F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), m["node"].alias("node"), m["more"].alias("more"), _beside(i).alias("own"))))
        found = met.select("g", each.alias("m"), "proof", "subroot", "root")
        found = found.select("g", F.col("m.pos").alias("block"), "m.node", "m.more", F.concat("m.own", "proof").alias("proof"), "subroot", "root")
        above = found.select("g", "block", "proof", "subroot", "root")
    return found.drop("block")


_PROOF = "array<struct<left:binary,right:binary>>"


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, group, leaf, subroot, root, proof`` and the columns ``carry`` of every row of ``docs``.

    ``proof`` is an array of (left, right), the digests beside the path from the leaf to the root, level by
    level: those of the tree of the group first, then those of the tree over the groups.  ``fold(leaf, proof)`` gives the root.

    Leaves of a group ascend by key (nulls first), rows with one key by their digest; rows that repeat
    are leaves of their own.  Groups ascend by UTF-8 bytes, the null group comes first and differs from the empty one.
    Null fields and empty texts have digests of their own; text length is not limited.  An empty table
    gives no row.  Names of other columns do not matter; ``carry`` may not repeat a name of the result.

    The texts are read once, to digests; only these are sorted.  A group with most of the rows is sorted
    and cut into blocks like any other set of rows.  Rounds are reliable checkpoints.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("g"), leaf(*columns).alias("node"), F.col(key).alias("key"),
        F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("more"),
    )
    # Equal rows are interchangeable; a number of the row spreads them over the ranges.
    rows = checkpointed(rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())))
    frames, subroots = _rounds(_placed(rows, ["key", "node", "spread"]).select("g", "pos", "n", "node", "more"))
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node", F.struct(F.col("g").alias("group"), F.col("node").alias("subroot")).alias("more"))
    high, last = _rounds(_placed(tops, ["name"]).select("g", "pos", "n", "node", "more"))
    none = F.array().cast(_PROOF)
    groups = _descend(high, last.select("g", none.alias("proof"), F.lit("").alias("subroot"), F.col("node").alias("root")))
    groups = groups.select(F.col("more.group").alias("g"), "proof", F.col("more.subroot").alias("subroot"), "root")
    found = _descend(frames, groups)
    return found.select(
        F.col("more.key").alias(key), F.col("more.group").alias(group), F.col("node").alias("leaf"), "subroot", "root", "proof",
        *(F.col(f"more.c{i}").alias(c) for i, c in enumerate(carry)),
    )
