"""Token ids as binary shards in training order.

All documents form one stream of ids, each closed by an end id, that is cut into sequences of fixed
length.  A keyed Feistel permutation with cycle-walking gives every sequence its global slot, so the
order is shuffled without sorting random numbers and any slot can be computed alone.  Each range of slots
is one file of fixed stride: the sequence of slot s starts at byte (s - first) * stride, so
training reads files in order and can resume anywhere.
"""

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import bpe
from memspark.llm.common import checkpointed, shared_folder, slices, text_or_empty
from memspark.session import broadcast_if


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF) for r in range(rounds)]

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> half, x & low
        for k in reversed(self.keys) if back else self.keys:
            if back:
                a, b = b ^ (bpe.mixed(a ^ k) & low), a
            else:
                a, b = b, a ^ (bpe.mixed(b ^ k) & low)
        return (a << half) | b

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._pass(np.asarray(x, np.uint64), back)
        while (out := x >= self.n).any():  # the domain is at most four times as large
            x[out] = self._pass(x[out], back)
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(np.atleast_1d(sequence), False)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(np.atleast_1d(slot), True)


@dataclass
class Shards:
    folder: str
    manifest: DataFrame  # shard, first_slot, sequences, tokens, file, crc32
    length: int
    sequences: int
    tokens: int
    key: int
    per_shard: int
    kind: str


def write_shards(
    docs: DataFrame, vocabulary: str, folder: str, text: str = "text", length: int = 2048, end: int = 50256, pad: int = 0, key: int = 1, shard_bytes: int = 16 << 20
) -> Shards:
    """Write the ids of every row below ``folder`` and return the description of the shards.

    A null or empty text is an end id; repeated rows are written as often as they occur; other columns are
    ignored; the last sequence is padded with ``pad``.  An empty table has no sequence and no file.
    The texts are encoded once, in one scan: their ids go to a checkpoint in blocks that carry the number of their
    partition and their place in it, and all that follows reads these blocks, so a cluster that loses or gains
    executors (and then splits the files otherwise) cannot move a token.  A shard whose pieces do not
    follow each other, or a sum of written tokens other than the counted one, fails the job.
    To the driver come the token counts of partitions, one number each.  Files get fresh names and count
    only when the manifest, a checkpoint, has them, so lost and repeated tasks do no harm.
    """
    kind = "<u2" if max(end, pad) < 1 << 16 and len(bpe.Merges(vocabulary).merged) < (1 << 16) - 512 else "<u4"
    stride = length * np.dtype(kind).itemsize
    spark = docs.sparkSession
    rows = docs.select(text_or_empty(text).alias("text"), F.spark_partition_id().alias("part"))

    def encode(batches):
        """Rows of (part, at, n, ids): ``n`` ids that begin ``at`` ids after the start of the partition."""
        encoder, press, at = bpe.encoder(vocabulary), zstandard.ZstdCompressor(3), 0
        for batch in slices(batches, "text"):
            ids, n = encoder.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(n), end).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part")[:1].cast(pa.int32()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([press.compress(ids.tobytes())], pa.binary())], ["part", "at", "n", "ids"]
            )
            at += len(ids)

    blocks = checkpointed(rows.mapInArrow(encode, "part int, at long, n long, ids binary"))
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    edges = np.cumsum([0, *(n for _, n in counts)])
    tokens = int(edges[-1])
    sequences = -(-tokens // length)
    per_shard = max(1, shard_bytes // stride)
    begin = spark.sparkContext.broadcast(dict(zip((p for p, _ in counts), edges.tolist(), strict=False)))
    order = Permutation(max(1, sequences), key)

    def place(batches):
        """Rows of (slot, offset, ids): whole sequences, and the two a block shares with others."""
        press, unpack = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for batch in batches:
            for part, at, packed in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                ids, at = np.frombuffer(unpack.decompress(packed.as_py()), kind), begin.value[part] + at
                edge = np.unique(np.concatenate(([0], np.arange((-at) % length, len(ids), length), [len(ids)])))
                first = at + edge[:-1]
                data = [press.compress(ids[a:b].tobytes()) for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order.slot(first // length), pa.int64()), pa.array((first % length).astype(np.int32), pa.int32()), pa.array(data, pa.binary())], ["slot", "offset", "ids"]
                )

    shard = F.floor(F.col("slot") / per_shard).cast("long")
    placed = blocks.select("part", "at", "ids").mapInArrow(place, "slot long, offset int, ids binary").withColumn("shard", shard)
    sorted_ = placed.repartition(max(1, -(-sequences // per_shard)), "shard").sortWithinPartitions("slot", "offset")

    def write(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        now, file, name, crc, done, size, n = None, None, None, 0, [], 0, 0
        width, unpack = np.dtype(kind).itemsize, zstandard.ZstdDecompressor()

        def close():
            nonlocal crc
            if file is not None:
                fill = (-size) % stride
                tail = np.full(fill // width, pad, kind).tobytes()
                file.write(tail)
                crc = zlib.crc32(tail, crc)
                file.close()
                done.append({"shard": now, "first_slot": now * per_shard, "sequences": (size + fill) // stride, "tokens": n, "file": name, "crc32": crc})

        last = None
        for batch in batches:
            for shard_no, slot, offset, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "offset", "ids")), strict=True):
                if shard_no != now:
                    close()
                    now, name, crc, size, n = shard_no, f"shard-{shard_no:08d}-{uuid.uuid4().hex}.bin", 0, 0, 0
                    file = fs.open_output_stream(f"{path}/{name}", compression=None)
                elif slot != last and size % stride:  # only the last sequence is short
                    tail = np.full((-size) % stride // width, pad, kind).tobytes()
                    file.write(tail)
                    crc, size = zlib.crc32(tail, crc), size + len(tail)
                if size != (slot - now * per_shard) * stride + offset * width:
                    raise ValueError(f"shard {now}: slot {slot} goes on at token {offset}, but {size} bytes are written")
                ids = unpack.decompress(ids)
                file.write(ids)
                crc, size, n, last = zlib.crc32(ids, crc), size + len(ids), n + len(ids) // width, slot
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("sequences", pa.int64()), ("tokens", pa.int64()), ("file", pa.string()), ("crc32", pa.int64())]))

    manifest = checkpointed(sorted_.select("shard", "slot", "offset", "ids").mapInArrow(write, "shard long, first_slot long, sequences long, tokens long, file string, crc32 long"))
    written = manifest.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("sequences"), F.lit(0))).first()
    if tuple(written) != (tokens, sequences):
        raise ValueError(f"{written[0]} tokens in {written[1]} sequences are written, {tokens} in {sequences} were counted")
    return Shards(folder, manifest, length, sequences, tokens, key, per_shard, kind)


def read_shards(spark: SparkSession, shards: Shards, from_slot: int = 0) -> DataFrame:
    """``slot, sequence_id, shard, n_tokens, ids`` (little-endian) from a slot on; files before it are not opened."""
    stride, length, key, n, tokens, kind, per_shard = shards.length * np.dtype(shards.kind).itemsize, shards.length, shards.key, shards.sequences, shards.tokens, shards.kind, shards.per_shard
    schema = "slot long, sequence_id long, shard long, n_tokens int, ids binary"
    if not n:
        return spark.createDataFrame([], schema)
    order = Permutation(n, key)

    def parse(batches):
        for batch in batches:
            for shard_no, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data, first = content.as_py(), shard_no * per_shard
                slot = np.arange(max(first, from_slot), first + len(data) // stride)
                seq = order.sequence(slot)
                size = np.minimum(length, tokens - seq * length)
                width = np.dtype(kind).itemsize
                ids = [data[(s - first) * stride : (s - first) * stride + k * width] for s, k in zip(slot.tolist(), size.tolist(), strict=True)]
                for a in range(0, len(ids), 1024):
                    cut = slice(a, a + 1024)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot[cut]), pa.array(seq[cut]), pa.array([shard_no] * len(ids[cut]), pa.int64()), pa.array(size[cut].astype(np.int32)), pa.array(ids[cut], pa.binary())],
                        ["slot", "sequence_id", "shard", "n_tokens", "ids"],
                    )

    # The contents stay where they are read: the list of files goes to them, up to a million of them.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(shards.folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    wanted = shards.manifest.filter(F.col("first_slot") + F.col("sequences") > from_slot).select("file", "shard")
    return files.join(broadcast_if(wanted, 1_000_000), "file").select("shard", "content").mapInArrow(parse, schema)


def training_order(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write shards and read them back (see ``write_shards`` and ``read_shards``)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "shards")
    return read_shards(spark, write_shards(docs, vocabulary, folder if "://" in folder else f"file://{folder}", **options))
