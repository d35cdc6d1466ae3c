"""Conversation prefix trie, built as a burst trie.

A turn is named by a digest of role and text, a conversation is the string of its turn names.  Equal
conversations are one entry.  Entries lie in containers of suffixes under trie heads.  A container with too
many entries is burst: what all its suffixes begin with becomes a chain of nodes, and the suffixes behind it
go to containers by their next turn.  Containers that are small enough are sorted and swept into nodes: a
stack holds the nodes from the top of the container to the last suffix, those the next one leaves are done.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm.common import checkpointed
from memspark.session import broadcast_if, union_all

_ID = 16  # bytes of a turn name
_HEADS = 200_000  # heads burst in one round that are sent to every task (about 20 MB)
_CHUNK = 1 << 18  # characters of a piece of a member list
NO_MEMBER = hashlib.sha256(b"").hexdigest()


def sequences(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, ids, sizes``: the names of all turns of a conversation as one binary string, and the bytes of their texts.

    Turns ascend (null first), rows with one turn by their names.  A null role or text is empty, rows with a null
    conversation are one conversation, rows that repeat are turns of their own.  Texts do not travel, their names do.
    """
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _ID)
    turns = messages.select(F.col(conversation).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), name.alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    found = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return found.select("conv", F.unhex(F.array_join("t.id", "")).alias("ids"), F.col("t.bytes").alias("sizes"))


def _digest_chunks(batches):
    """Rows sorted by entry and member to pieces of each entry's member list."""
    entry, first, held, size = None, None, [], 0
    for batch in batches:
        for e, c in zip(batch.column("entry").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if held and (e != entry or size >= _CHUNK):
                yield _batch(entry=[entry], first=[first], part=[",".join(held)])
                held, size = [], 0
            if not held:
                entry, first = e, c
            held.append(str(c))
            size += len(held[-1])
    if held:
        yield _batch(entry=[entry], first=[first], part=[",".join(held)])


def _digests(batches):
    """Pieces sorted by entry and first member to one digest for each entry; a piece is held at a time."""
    entry, state = None, None
    out = []
    for batch in batches:
        for e, part in zip(batch.column("entry").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if state is None or e != entry:
                if state is not None:
                    out.append((entry, state.hexdigest()))
                entry, state = e, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        if len(out) > 10_000:
            yield _batch(entry=[o[0] for o in out], ends=[o[1] for o in out])
            out = []
    if state is not None:
        out.append((entry, state.hexdigest()))
    if out:
        yield _batch(entry=[o[0] for o in out], ends=[o[1] for o in out])


def _batch(**columns: list) -> pa.RecordBatch:
    types = {"entry": pa.binary(), "first": pa.int64(), "part": pa.string(), "ends": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], names=list(columns))


def entries(found: DataFrame) -> DataFrame:
    """``entry, ids, sizes, n, conv, ends``: different conversations, their number of members, the smallest and the digest of all.

    Counting merges copies in the map tasks.  Member lists are sorted by ranges of (entry, member), so those of a conversation with
    most of the members lie in many tasks; the digest of a list is defined over the whole of it and is fed piece by piece.
    """
    named = found.withColumn("entry", F.unhex(F.substring(F.sha2("ids", 256), 1, 2 * _ID)))
    once = named.groupBy("entry").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    members = named.select("entry", "conv").filter(F.col("conv").isNotNull())
    pieces = members.repartitionByRange("entry", "conv").sortWithinPartitions("entry", "conv").mapInArrow(_digest_chunks, "entry binary, first long, part string")
    ends = pieces.repartition("entry").sortWithinPartitions("entry", "first").mapInArrow(_digests, "entry binary, ends string")
    return once.join(ends, "entry", "left").select("entry", "ids", "sizes", "n", "conv", F.coalesce("ends", F.lit(NO_MEMBER)).alias("ends"))


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Turns that two name strings have in common at their beginning."""
    return pd.Series([_shared(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _ID
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // _ID


class _Node:
    __slots__ = ("depth", "size", "n", "conv", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends = None, NO_MEMBER
        self.waiting: list[_Node] = []  # children whose parent_conv_id is not known yet

    def holds(self, n: int, conv: int | None) -> None:
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def closed(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size

    def take(self, child: "_Node") -> None:
        self.holds(child.n, child.conv)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved
        self.waiting.append(child)

    def row(self, parent: int | None, head: bytes | None, path: list[bytes] | None) -> tuple:
        return (self.conv, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.ends, head, path)


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"{_NODE}, head binary, path array<binary>"
_ARROW = pa.schema([
    *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("head", pa.binary()), ("path", pa.list_(pa.binary())),
])


def _sweep(batches) -> Iterator[pa.RecordBatch]:
    """Entries sorted by container and names to nodes.  The top node of a container carries its head and path."""
    rows: list[tuple] = []
    stack: list[_Node] = []
    box = before = parent = path = None

    def pop() -> None:
        node = stack.pop()
        node.closed()
        rows.extend(c.row(node.conv, None, None) for c in node.waiting)
        node.waiting = []
        if stack:
            stack[-1].take(node)
        else:
            rows.append(node.row(parent, box, path))

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    for batch in batches:
        names = ("head", "at", "parent", "path", "ids", "sizes", "n", "conv", "ends")
        for head, at, above, heads, ids, sizes, n, conv, ends in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if head != box:
                while stack:
                    pop()
                box, parent, path, before = head, above, heads, None
                stack.append(_Node(at, sizes[at - 1] if at else 0))
            keep = at if before is None else max(at, _shared(before, ids))
            while stack[-1].depth > keep:
                pop()
            for depth in range(keep + 1, len(sizes) + 1):
                stack.append(_Node(depth, sizes[depth - 1]))
            stack[-1].holds(n, conv)
            stack[-1].ends, before = ends, ids
            if len(rows) > 20_000:
                yield packed()
    while stack:
        pop()
    if rows:
        yield packed()


def trie(found: DataFrame, container: int = 4096) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``found(conv, ids, sizes)`` as from ``sequences``; a conversation without turns has empty names and is a member of the
    root only.  A null conversation counts as a member but has no id: a node with no other has a null ``conv_id``, lists
    of members leave it out.  Conversations that repeat are members of one node.  Without any conversation there is no node.

    ``container`` is the number of different suffixes from which a container is burst.  Each round counts the
    entries of every container, merged in the map tasks; only entries of burst containers move on.  A chain of any length
    is one round, so rounds follow the branchings that more than ``container`` entries share.  A
    container is swept by one task; at most as many nodes wait there as it has turns.
    """
    start = entries(found).select(F.lit(b"").alias("head"), F.lit(0).alias("at"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<binary>").alias("path"), "ids", "sizes", "n", "conv", "ends")
    active = checkpointed(start)
    small, chains = [], []
    while True:
        counts = active.groupBy("head").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("all"), F.min("conv").alias("least"), F.min("ids").alias("low"), F.max("ids").alias("high"))
        big = checkpointed(counts.filter(F.col("entries") > container).withColumn("to", _common("low", "high")).drop("entries", "high"))
        known = big.select("head", "all", "least", "to")
        if big.isEmpty():
            small.append(active)
            break
        small.append(active.join(broadcast_if(big.select("head"), _HEADS), "head", "left_anti"))
        met = active.join(broadcast_if(known, _HEADS), "head")
        lowest = F.min_by(F.struct("sizes", "at", "parent", "path", F.when(F.length("ids") == F.col("to") * _ID, F.col("ends")).alias("ends")), "ids").alias("x")
        chains.append(checkpointed(met.groupBy("head", "all", "least", "to").agg(lowest)))
        after = (F.col("to") + 1).alias("at")
        child = F.unhex(F.substring(F.sha2(F.substring("ids", F.lit(1), (F.col("to") + 1) * _ID), 256), 1, 2 * _ID))
        rest = met.filter(F.length("ids") > F.col("to") * _ID)
        active = checkpointed(rest.select(child.alias("head"), after, F.col("least").alias("parent"), F.array_append("path", F.col("head")).alias("path"), "ids", "sizes", "n", "conv", "ends"))
    boxes = union_all(*small).repartition("head").sortWithinPartitions("head", "ids")
    swept = boxes.mapInArrow(_sweep, _SWEPT)
    plain = _NODE.replace(" long", "").replace(" string", "").split(", ")
    if not chains:
        return swept.select(*plain)
    swept = checkpointed(swept)
    return union_all(swept.select(*plain), _chain_nodes(union_all(*chains), swept).select(*plain))


def _chain_nodes(chains: DataFrame, swept: DataFrame) -> DataFrame:
    """Nodes of all burst heads; their sums come from the containers and chains below, each of which knows its path."""
    own = F.transform(F.filter(F.sequence(F.col("x.at"), F.col("to")), lambda d: d > 0), lambda d: (F.col("all") - 1) * F.get(F.col("x.sizes"), d - 1))
    chain = chains.withColumn("total", F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b))
    tops = swept.filter(F.col("head").isNotNull())
    given = union_all(
        tops.select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")),
        chain.select(F.array_append("x.path", F.col("head")).alias("path"), F.lit(0).cast("long").alias("leaves"), F.col("total").alias("saved")),
    )
    sums = given.select(F.explode("path").alias("head"), "leaves", "saved").groupBy("head").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
    children = union_all(tops.select("path"), chain.select(F.col("x.path").alias("path"))).filter(F.size("path") > 0)
    children = children.groupBy(F.element_at("path", -1).alias("head")).agg(F.count(F.lit(1)).alias("branches"))
    rows = chain.join(sums, "head").join(children, "head")
    rows = rows.select("all", "least", "to", "branches", "leaves", F.col("below").alias("saved"), "x.at", "x.parent", "x.sizes", F.coalesce("x.ends", F.lit(NO_MEMBER)).alias("ends"))
    return rows.mapInArrow(_chain, _NODE)


def _chain(batches) -> Iterator[pa.RecordBatch]:
    """The nodes of each chain, top down; all have the same members and leaves."""
    for batch in batches:
        for c in batch.to_pylist():
            out, saved, parent = [], c["saved"], c["parent"]
            for depth in range(c["at"], c["to"] + 1):
                last = depth == c["to"]
                out.append((c["least"], depth, parent, c["all"], c["branches"] if last else 1, c["leaves"], saved, c["ends"] if last else NO_MEMBER))
                saved -= (c["all"] - 1) * c["sizes"][depth - 1] if depth else 0
                parent = c["least"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _ARROW.types, strict=False)], names=_ARROW.names[:8])
