"""Best-fit packing of token sequences with certified bin counts.

Documents become ids and are cut into pieces of at most one sequence.  Each partition packs its
pieces by best-fit decreasing and compares its bins with a lower bound from dual-feasible
functions.  Partitions that meet the bound are certified optimal; the others give up their loosely filled bins, whose
pieces are dealt to new partitions and packed again, as long as that saves bins.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import bpe
from memspark.llm.common import checkpointed, slices, text_or_empty

_PIECES = 50_000  # of a partition, on average


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, key: str = "doc_id", text: str = "text", end: int = 0, with_ids: bool = False) -> DataFrame:
    """``row, key, piece, start, length, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit) of every piece.

    A document is the ids of its text and the id ``end``; one longer than ``size`` is cut so that all
    pieces but the first are full.
    """

    def cut(batches):
        encoder = bpe.encoder(vocabulary)
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            out = {n: [] for n in ("at", "piece", "start", "length", "ids_crc32", "ids")}
            lo = 0
            for i, n in enumerate(counts.tolist()):
                doc = np.append(ids[lo : lo + n], np.uint32(end)).astype("<u4")
                lo += n
                first = (n + 1) - ((n + 1) - 1) // size * size
                edges = [0, *range(first, n + 2, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    data = doc[a:b].tobytes()
                    for name, value in zip(out, (i, k, a, b - a, zlib.crc32(data), data if with_ids else None), strict=True):
                        out[name].append(value)
            keys = batch.select(["row", "key"]).take(pa.array(out["at"], pa.int64()))
            columns = [pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32"))]
            columns += [pa.array(out["ids"], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*keys.columns, *columns], ["row", "key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(cut, f"row long, key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def lower_bound(lengths: np.ndarray, counts: np.ndarray, size: int) -> int:
    """No packing of ``counts[i]`` pieces of ``lengths[i]`` into bins of ``size`` has fewer bins.

    The largest value of three families of dual-feasible functions (Fekete and Schepers), in whole numbers:
    f maps lengths so that what fits into one bin still sums to one bin at most, hence
    the sum of f over all pieces bounds the number of bins.
    """
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    if not n.sum():
        return 0
    over = lambda total, unit: -(-int(total) // int(unit))
    best = over((x * n).sum(), size)
    for k in range(1, 33):
        best = max(best, over((np.where((k + 1) * x % size == 0, x * k, (k + 1) * x // size * size) * n).sum(), k * size))
    for e in np.unique(x[2 * x <= size]).tolist():
        best = max(best, over((np.where(x > size - e, size, np.where(x >= e, x, 0)) * n).sum(), size))
        q = size // e
        best = max(best, over((np.where(2 * x > size, 2 * (q - (size - x) // e), np.where(2 * x == size, q, 2 * (x // e))) * n).sum(), 2 * q))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every piece, and the room left in every bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[int] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room
    rooms = 0  # bit r is set when a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(left)
            left.append(size)
        bins[i], offsets[i] = b, size - room
        left[b] = room - n
        if left[b]:
            if not free[left[b]]:
                rooms |= 1 << left[b]
            free[left[b]].append(b)
    return bins, offsets, np.array(left, np.int64)


def _packer(size: int):
    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        # The same pieces always meet in the same order, so a repeated task gives the same bins.
        order = np.lexsort((group.column("piece").to_numpy(), group.column("row").to_numpy()))
        group, lengths = group.take(pa.array(order)), lengths[order]
        bins, offsets, left = best_fit(lengths, size)
        values, counts = np.unique(lengths, return_counts=True)
        gap = len(left) - lower_bound(values, counts, size)
        new = {"bin": bins, "offset": offsets, "room": left[bins], "gap": np.full(len(bins), gap)}
        for name, values in new.items():
            at = group.column_names.index(name)
            group = group.set_column(at, name, pa.array(values, pa.int64()))
        return group

    return pack


@dataclass
class Packing:
    pieces: DataFrame
    sequences: int
    bound: int


def pack(parts: DataFrame, size: int = 2048, rounds: int = 6, per_partition: int = _PIECES) -> Packing:
    """Place pieces (``row, piece, length``, any further columns) into sequences of at most ``size``.

    The result adds ``sequence_id`` and ``offset`` to the pieces; ``sequences`` is their number and ``bound`` the
    certified minimum over all pieces, so ``sequences - bound`` is the most any other packing could save.
    Only a histogram of lengths (``size`` rows at most) and sums come to the driver.  Zero-length pieces are not allowed.
    """
    names = parts.columns
    zero = F.lit(0).cast("long")
    state = checkpointed(parts)
    histogram = state.groupBy("length").count().orderBy("length").collect()
    bound = lower_bound(np.array([r["length"] for r in histogram]), np.array([r["count"] for r in histogram]), size)
    total = sum(r["count"] for r in histogram)

    def packed(rows: DataFrame, count: int, turn: int) -> DataFrame:
        groups = max(1, -(-count // per_partition))
        rows = rows.select(*names, F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(groups)).alias("part"), F.lit(turn).alias("turn"), *(zero.alias(c) for c in ("bin", "offset", "room", "gap")))
        return checkpointed(rows.groupBy("part").applyInArrow(_packer(size), rows.schema))

    bins = lambda rows: rows.agg(F.count_if(F.col("offset") == 0)).first()[0]
    state = packed(state, total, 0)
    sequences, closed = bins(state), None
    for turn in range(1, rounds + 1):
        if sequences == bound:
            break
        # A bin with hardly any room cannot help; neither can bins of a partition that meets its bound.
        open_ = (F.col("gap") > 0) & (F.col("room") * 100 >= size)
        loose = state.filter(open_)
        count, before = loose.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        if not count:
            break
        again = packed(loose, count, turn)
        after = bins(again)
        if after >= before:
            break
        rest = state.filter(~open_)
        closed = rest if closed is None else closed.union(rest)
        state, sequences = again, sequences - before + after
    whole = state if closed is None else closed.union(state)
    number = (F.col("turn").cast("long") * (1 << 58)) + F.col("part") * (1 << 22) + F.col("bin")
    return Packing(whole.select(*names, number.alias("sequence_id"), "offset"), sequences, bound)


def packed_documents(docs: DataFrame, vocabulary: str, size: int = 2048, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` of every piece (see ``pieces`` and ``pack``).

    A null or empty text is the end id alone; repeated rows are packed as often as they occur; null keys stay null.
    """
    found = pack(pieces(docs, vocabulary, size, key, text, with_ids=with_ids), size)
    return found.pieces.drop("row").withColumnRenamed("key", key)
