"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF word shingles.

Steps, each a shuffle on an evenly spread key:

1. Equal texts are merged (by SHA-256, inside the map tasks first); one text of each goes on.
2. Shingles are hashed in chunks of about 2 MB of text and dealt out by hash range, as packed arrays.
3. Each range counts document frequencies, turns its entries into weights and sends each chunk the
   entries that other texts hold too; the rest comes back as a count per text.
4. A text whose common shingles carry less than the threshold of its weight has no partner (exact
   test).  The others get their samples: every common shingle with its own random numbers, every
   shingle of its own with private ones, which cannot match anything anyway.
5. Samples are grouped to bands; in each bucket of texts all members are compared with one of them,
   and what the found links leave in different components is compared as well, so no candidate pair
   is skipped and a bucket of copies costs one comparison per member.  Large buckets meet in blocks.
6. Every candidate pair is verified by its exact weighted Jaccard similarity.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm import bpe
from memspark.llm.common import checkpointed, slices, text_or_empty
from memspark.operators.safety import components

_CHUNK = 2 << 20
_DOCS = 60_000  # of a chunk at most, so that a place in it fits 16 bits
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle: ``width`` neighbouring words, in lower case.

    A word is a run of letters and digits.  A text of fewer words has one shingle of them all, one
    without words has none.
    """
    texts = [t.lower() for t in texts]
    codes = bpe.code_points("".join(texts))
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    cls = bpe.char_classes()[codes]
    word = (cls == bpe.LETTER) | (cls == bpe.NUMBER)
    first = np.zeros(len(codes) + 1, bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    before = np.append(False, word[:-1]) & ~first[:-1]
    after = np.append(word[1:], False) & ~np.append(first[1:-1], True)
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    hashes = bpe.span_hashes(codes, starts, ends)
    words = np.bincount(owner, minlength=len(texts))
    rank = np.arange(len(starts)) - (np.cumsum(words) - words)[owner]
    n = words[owner]
    at = np.flatnonzero((rank + width <= n) | (rank == 0))
    total = np.zeros(len(at), np.uint64)
    padded = np.append(hashes, np.zeros(width, np.uint64))
    for j in range(width):
        total = total * _STEP + np.where(rank[at] + j < n[at], padded[at + j], np.uint64(0))
    return bpe.mixed(total), owner[at]


def _shingles_in_parts(texts: list[str], width: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``word_shingles`` of about ``limit`` characters at a time."""
    hashes, owners, lo = [], [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= limit):
            size += len(texts[hi])
            hi += 1
        h, owner = word_shingles(texts[lo:hi], width)
        hashes.append(h)
        owners.append(owner + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(owners)


def _chunks(batches):
    """Slices of about ``_CHUNK`` bytes that hold no more than ``_DOCS`` rows."""
    waiting, size = [], 0
    for batch in slices(batches, "text", _CHUNK):
        for piece in (batch.slice(i, _DOCS) for i in range(0, batch.num_rows, _DOCS)):
            if waiting and (size + piece.nbytes > _CHUNK or sum(map(len, waiting)) + len(piece) > _DOCS):
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
            waiting.append(piece)
            size += piece.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting)


def _dealer(ranges: int, width: int):
    """Step 2: a chunk's shingles by range; the first range also carries the chunk's text ids."""

    def deal(batches):
        for chunk in _chunks(batches):
            digests = chunk.column("digest").to_pylist()
            texts = chunk.column("text").to_pylist()
            h, owner = _shingles_in_parts(texts, width)
            of = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(of.astype(np.uint16) if ranges <= 1 << 16 else of, kind="stable")
            h, owner, of = h[order].astype(np.uint32), owner[order], of[order].astype(np.int64)
            used, lo = np.unique(of, return_index=True)
            hi = np.append(lo, len(of))[1:]
            rows = [(int(r), np.bincount(owner[a:b], minlength=len(texts)), h[a:b]) for r, a, b in zip(used, lo, hi, strict=True)]
            if not len(used) or used[0]:
                rows.insert(0, (0, np.zeros(len(texts), np.int64), h[:0]))
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digests[0]] * len(part), pa.binary()), pa.array([r for r, _, _ in part], pa.int64()),
                        pa.array([b"".join(digests) if r == 0 else None for r, _, _ in part], pa.binary()),
                        pa.array([_narrow(n) for _, n, _ in part], pa.binary()), pa.array([x.tobytes() for _, _, x in part], pa.binary()),
                    ],
                    ["chunk", "range", "digests", "counts", "hashes"],
                )

    return deal


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes; 255 and more are followed by full numbers at the end."""
    big = counts[counts >= 255].astype(np.uint32)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes() + np.uint32(len(big)).tobytes()


def _wide(data: bytes) -> np.ndarray:
    big = int(np.frombuffer(data[-4:], np.uint32)[0])
    out = np.frombuffer(data[: len(data) - 4 - 4 * big], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[len(data) - 4 - 4 * big : len(data) - 4], np.uint32)
    return out


def idf(df: np.ndarray, texts: int, spread: float) -> np.ndarray:
    """1 for a shingle of every text up to 1 + ``spread`` for one that a single text holds.

    The range is bounded so that copies cannot make each other's shingles worthless, however many
    they are, and a few changed words cannot outweigh a long common passage.
    """
    return 1 + spread * (1 - np.log(df) / np.log(max(texts, 2)))


def _weigher(texts: int, spread: float):
    """Step 3, for one range: rows as dealt to rows of (chunk, range, digests, own, counts, hashes, weights)."""

    def weigh(group: pa.Table) -> pa.Table:
        counts = [_wide(x) for x in group.column("counts").to_pylist()]
        parts = [np.frombuffer(x, np.uint32) for x in group.column("hashes").to_pylist()]
        base = np.cumsum([0, *map(len, counts)])
        doc = np.concatenate([np.repeat(np.arange(len(c)) + b, c) for c, b in zip(counts, base[:-1], strict=True)]).astype(np.int64)
        h = np.concatenate(parts)
        order = np.argsort((h.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64))
        h, doc = h[order], doc[order]
        new_hash = np.append(True, h[1:] != h[:-1])[: len(h)]
        new_pair = new_hash | np.append(True, doc[1:] != doc[:-1])[: len(h)]
        at = np.flatnonzero(new_pair)
        tf = np.diff(np.append(at, len(h)))
        h, doc, group_no = h[at], doc[at], np.cumsum(new_hash[at]) - 1
        df = np.bincount(group_no)[group_no] if len(at) else np.empty(0, np.int64)
        single = (df == 1) & (tf == 1)
        own = np.bincount(doc[single], minlength=base[-1])
        h, doc, df, tf = h[~single], doc[~single], df[~single], tf[~single]
        # The sign tells shingles that no other text holds (met twice or more in their own).
        weight = (tf * idf(df, texts, spread) * np.where(df > 1, 1, -1)).astype(np.float32)
        order = np.argsort(doc, kind="stable")
        h, doc, weight = h[order], doc[order], weight[order]
        cut = np.searchsorted(doc, base)
        sent = np.bincount(doc, minlength=base[-1])
        return pa.table(
            {
                "chunk": group.column("chunk"), "range": group.column("range"), "digests": group.column("digests"),
                "own": pa.array([_narrow(own[a:b]) for a, b in zip(base, base[1:], strict=False)], pa.binary()),
                "counts": pa.array([_narrow(sent[a:b]) for a, b in zip(base, base[1:], strict=False)], pa.binary()),
                "hashes": pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                "weights": pa.array([weight[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
            }
        )

    return weigh


def consistent_samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int, block: int = 1 << 16) -> np.ndarray:
    """``samples`` improved consistent weighted samples (Ioffe 2010) of every set, as 32-bit values.

    Two sets agree in a sample with the probability of their weighted Jaccard similarity.  The sets
    are the stretches of ``keys`` that begin at ``starts``; r and c are Gamma(2, 1), b is uniform.
    """
    out = np.empty((len(starts), samples), np.uint32)
    edges = np.append(starts, len(keys))
    if len(keys) > block and len(starts) > 1:  # whole sets, about ``block`` elements at a time
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + block, side="right")) - 1)
            part = slice(edges[lo], edges[hi])
            out[lo:hi] = consistent_samples(keys[part], weights[part], starts[lo:hi] - edges[lo], samples, len(keys))
            lo = hi
        return out
    size = np.diff(edges)
    log_w = np.log(weights.astype(np.float64))
    for k in range(samples):
        u = bpe.mixed(keys + np.uint64((k + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        v = bpe.mixed(u ^ _STEP)
        low = np.uint64(0xFFFFFFFF)
        r = -np.log(((u >> np.uint64(32)) + 0.5) * ((u & low) + 0.5) * 2.0**-64)
        log_c = np.log(-np.log(((v >> np.uint64(40)) + 0.5) * (((v >> np.uint64(16)) & np.uint64(0xFFFFFF)) + 0.5) * 2.0**-48))
        b = ((v & np.uint64(0xFFFF)) + 0.5) * 2.0**-16
        t = np.floor(log_w / r + b)
        log_a = log_c - r * (t - b) - r
        least = np.minimum.reduceat(log_a, starts)
        hit = np.flatnonzero(log_a == np.repeat(least, size))
        of = np.searchsorted(starts, hit, side="right")
        hit = hit[np.append(True, of[1:] != of[:-1])]
        out[:, k] = bpe.mixed(keys[hit] + t[hit].astype(np.int64).astype(np.uint64) * _STEP + np.uint64(k)) >> np.uint64(32)
    return out


def _sampler(texts: int, spread: float, threshold: float, bands: int, rows: int):
    """Step 4, for one chunk: texts that can have a partner, with their bands and common shingles."""

    def sample(group: pa.Table) -> pa.Table:
        digests = next(d for d in group.column("digests").to_pylist() if d is not None)
        digests = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        order = np.argsort(group.column("range").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        own = sum(_wide(x) for x in group.column("own").to_pylist())
        counts = [_wide(x) for x in group.column("counts").to_pylist()]
        doc = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
        key = np.concatenate(
            [(np.frombuffer(h, np.uint32).astype(np.uint64) | np.uint64(r << 32)) for h, r in zip(group.column("hashes").to_pylist(), group.column("range").to_pylist(), strict=True)]
        )
        weight = np.concatenate([np.frombuffer(w, np.float32) for w in group.column("weights").to_pylist()]).astype(np.float64)
        common = weight > 0
        most = float(idf(np.array(1.0), texts, spread))
        total = np.bincount(doc, np.abs(weight), len(digests)) + own * most
        shared = np.bincount(doc[common], weight[common], len(digests))
        able = (shared >= threshold * total * (1 - 1e-5)) & (shared > 0)
        chosen = np.flatnonzero(able)
        if not len(chosen):
            return pa.table({"digest": pa.array([], pa.binary()), "total": pa.array([], pa.float64()), "ratio": pa.array([], pa.float64()), "bands": pa.array([], pa.list_(pa.int64())), "keys": pa.array([], pa.binary()), "weights": pa.array([], pa.binary())})
        take = able[doc]
        doc, key, weight = doc[take], key[take], weight[take]
        # Shingles met once and nowhere else: private keys with the same weight.
        alone = np.repeat(chosen, own[chosen])
        salt = np.array([int.from_bytes(digests[i][:8], "little") for i in chosen], np.uint64)
        number = np.arange(len(alone)) - np.repeat(np.cumsum(own[chosen]) - own[chosen], own[chosen])
        private = bpe.mixed(np.repeat(salt, own[chosen]) + number.astype(np.uint64) * _STEP)
        all_doc = np.append(doc, alone)
        order = np.argsort(all_doc, kind="stable")
        all_doc = all_doc[order]
        values = consistent_samples(
            np.append(bpe.mixed(key), private)[order], np.append(np.abs(weight), np.full(len(alone), most))[order], np.searchsorted(all_doc, chosen), bands * rows
        )
        band = np.zeros((len(chosen), bands), np.uint64)
        for j in range(rows):
            band = bpe.mixed(band * _STEP + values[:, j::rows][:, :bands])
        keep = weight > 0
        doc, key, weight = doc[keep], key[keep], weight[keep].astype(np.float32)
        order = np.lexsort((key, doc))
        doc, key, weight = doc[order], key[order], weight[order]
        cut = np.append(np.searchsorted(doc, chosen), len(doc))
        return pa.table(
            {
                "digest": pa.array([digests[i] for i in chosen], pa.binary()), "total": pa.array(total[chosen]), "ratio": pa.array(shared[chosen] / total[chosen]),
                "bands": pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                "keys": pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                "weights": pa.array([weight[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
            }
        )

    return sample


def _similar(threshold: float):
    def keep(batches):
        for batch in batches:
            x = {c: batch.column(c).to_pylist() for c in ("ka", "wa", "ta", "kb", "wb", "tb")}
            found = []
            for ka, wa, ta, kb, wb, tb in zip(*x.values(), strict=True):
                a, b = np.frombuffer(ka, np.uint64), np.frombuffer(kb, np.uint64)
                _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                both = float(np.minimum(np.frombuffer(wa, np.float32)[i], np.frombuffer(wb, np.float32)[j]).sum(dtype=np.float64))
                found.append(both >= threshold * (ta + tb - both) * (1 - 1e-6))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return keep


def _verified(pairs: DataFrame, able: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    side = lambda n: able.select(*(F.col(c).alias(f"{c[0] if c != 'digest' else ''}{n}") for c in ("digest", "keys", "weights", "total")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ka", "wa", "ta", "kb", "wb", "tb").mapInArrow(_similar(threshold), "a binary, b binary")


def digest_of(text: str | Column = "text") -> Column:
    """16 bytes that name a text: the first half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text_or_empty(text), 256)), 1, 16)


def candidates(docs: DataFrame, text: str, threshold: float, width: int, bands: int, rows: int, spread: float, different: bool = False) -> DataFrame:
    """Steps 1 to 4: ``digest, total, ratio, bands, keys, weights`` of the texts that can have a partner."""
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    texts, ranges = size[0], max(1, -(-(size[1] or 0) // _CHUNK))
    distinct = docs.select(digest_of(text).alias("digest"), text_or_empty(text).alias("text"))
    if not different:
        distinct = distinct.groupBy("digest").agg(F.first("text").alias("text"))
    dealt = distinct.sortWithinPartitions("digest").mapInArrow(_dealer(ranges, width), "chunk binary, range long, digests binary, counts binary, hashes binary")
    weighed = dealt.groupBy("range").applyInArrow(_weigher(texts, spread), "chunk binary, range long, digests binary, own binary, counts binary, hashes binary, weights binary")
    return weighed.groupBy("chunk").applyInArrow(
        _sampler(texts, spread, threshold, bands, rows), "digest binary, total double, ratio double, bands array<long>, keys binary, weights binary"
    )


def _across(threshold: float):
    """Links between the components of large buckets; one for each pair of components of a comparison."""

    def compare(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).to_pylist() for c in group.column_names}
        where = {}
        for r, at in enumerate(zip(column["band"], column["value"], column["i"], column["j"], strict=True)):
            where.setdefault(at, []).append(r)
        out = {}
        for rows in where.values():
            keys = [np.frombuffer(column["keys"][r], np.uint64) for r in rows]
            weights = [np.frombuffer(column["weights"][r], np.float32) for r in rows]
            total = np.array([column["total"][r] for r in rows])
            names, part = np.unique(np.array([column["component"][r].hex() for r in rows]), return_inverse=True)
            if len(names) < 2:
                continue
            size = np.array([len(k) for k in keys])
            vocabulary, feature = np.unique(np.concatenate(keys), return_inverse=True)
            matrix = np.zeros((len(rows), len(vocabulary)), np.float32)
            matrix[np.repeat(np.arange(len(rows)), size), feature] = np.concatenate(weights)
            small = np.flatnonzero(part != np.bincount(part).argmax())
            for x in small:
                held = np.flatnonzero(matrix[x])
                both = np.minimum(matrix[:, held], matrix[x, held]).sum(1, dtype=np.float64)
                near = (both >= threshold * (total + total[x] - both) * (1 - 1e-6)) & (part != part[x])
                for y in np.flatnonzero(near):
                    out.setdefault(tuple(sorted((names[part[x]], names[part[y]]))), (column["digest"][rows[x]], column["digest"][rows[y]]))
        pairs = [sorted(p) for p in out.values()]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return compare


def links(able: DataFrame, threshold: float, large: int = 64, block: int = 256) -> DataFrame:
    """Verified pairs (a, b) that connect the same texts as all similar candidate pairs do.

    Buckets up to ``large`` members give their remaining pairs, bigger ones meet in blocks.
    """
    members = checkpointed(able.select("digest", "ratio", F.posexplode("bands").alias("band", "value")))
    # The member with the largest part of common shingles leads: a text others were copied from has no own ones.
    order = F.struct(-F.col("ratio"), F.col("digest").alias("leader"))
    leaders = members.groupBy("band", "value").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leaders = leaders.select("band", "value", F.col("m.leader").alias("leader"), "n")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = members.join(leaders, ["band", "value"]).filter("digest <> leader").select(*pair("digest", "leader")).distinct()
    first = checkpointed(_verified(star, able, threshold))
    # Buckets that the links found so far leave in several components: every pair across them.
    part = components(first)
    placed = members.join(leaders.select("band", "value", "n"), ["band", "value"]).join(part.withColumnRenamed("node", "digest"), "digest", "left")
    placed = placed.select("band", "value", "n", "digest", F.coalesce("component", "digest").alias("component"))
    mixed = placed.groupBy("band", "value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band", "value")
    placed = checkpointed(placed.join(mixed, ["band", "value"], "left_semi"))
    some = placed.filter(F.col("n") <= large).drop("n")
    other = some.select("band", "value", F.col("digest").alias("partner"), F.col("component").alias("other"))
    rest = some.join(other, ["band", "value"]).filter("component < other").select(*pair("digest", "partner")).distinct().join(star, ["a", "b"], "left_anti")
    many = placed.filter(F.col("n") > large).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("place", F.pmod(F.xxhash64("digest"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("band", "value", "digest", "component", F.least("place", "with").alias("i"), F.greatest("place", "with").alias("j"))
    many = many.join(able.select("digest", "keys", "weights", "total"), "digest")
    blocks = many.groupBy("band", "value", "i", "j").applyInArrow(_across(threshold), "a binary, b binary")
    return first.union(_verified(rest, able, threshold)).union(blocks)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 16, rows: int = 4, spread: float = 0.25,
    different: bool = False, row: str | None = None,
) -> DataFrame:
    """``key, component_id, group_size, kept`` of every row.

    Two texts are linked when the weighted Jaccard similarity of their shingle weights (count times
    ``idf``) is at least ``threshold``, and equal texts always are; ``component_id`` is the smallest
    key of a row that can be reached by links, and that row is the one kept.  Frequencies are counted over different texts, so exact copies do
    not change them.  At 0.8 a pair shares one of 16 bands of 4 samples with probability 0.9998.

    A null text counts as empty; texts without words are linked with equal texts only.  Null keys are
    larger than all others; a group of null keys only has a null ``component_id``.  Of repeated rows
    with one key and text one is kept.  Other columns are ignored.

    ``different`` tells that no two texts are equal, which saves the shuffle of step 1; ``row`` names a
    column of ``docs`` with a stored number for every row, and the result then has it as ``row``.  Without one, rows
    are numbered in one scan and kept in a checkpoint.
    """
    able = checkpointed(candidates(docs, text, threshold, width, bands, rows, spread, different))
    part = components(links(able, threshold)).withColumnRenamed("node", "digest")
    rows_ = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("key"), digest_of(text).alias("digest"))
    rows_ = checkpointed(rows_.join(part, "digest", "left").select("row", "key", F.coalesce("component", "digest").alias("class")))
    best = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row"))
    groups = rows_.groupBy("class").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = rows_.join(groups, "class").select(
        F.col("key").alias(key), F.col("best.key").alias("component_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "row"
    )
    return out if row else out.drop("row")
