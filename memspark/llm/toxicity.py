"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary texts and one on what toxic texts add to
them.  A window of a text that becomes shorter with the toxic dictionary than without it speaks for
label 1.  How often windows gain how many bytes is calibrated against labels to a score; everything
is learned from a bounded sample of labelled rows, every text is scored in whole.
"""

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import free_name, like, slices, text_or_empty

WINDOW, OVERLAP, LEVEL = 64, 16, 9
ORDINARY_BYTES, TOXIC_BYTES = 16384, 1024
_STEPS = range(1, 9)  # bytes gained that are counted apart
_PUNCTUATION = b".,;:!?()\"'|"


def plain(text: str | None) -> bytes:
    """Lower case with single spaces, UTF-8."""
    return b" " + b" ".join((text or "").lower().encode().split()) + b" "


def windows(body: bytes) -> list[bytes]:
    """The whole body in windows that overlap by the length of a long word."""
    step = WINDOW - OVERLAP
    return [body[i : i + WINDOW] for i in range(0, max(1, len(body) - OVERLAP), step)]


def _pieces(body: bytes) -> set[bytes]:
    """Beginnings of words and whole words."""
    out = set()
    for word in set(body.split()):
        word = b" " + word.strip(_PUNCTUATION)
        out.update(word[:n] for n in range(5, min(len(word), 24) + 1))
        out.add(word + b" ")
    return out


def toxic_pieces(toxic: list[bytes], ordinary: list[bytes], most: int = 400) -> list[bytes]:
    """What toxic texts add: the pieces with the largest log-likelihood gain that cover them.

    Taken in falling order of gain, one of each chain of prefixes, as long as a piece covers texts
    that fewer than two others cover.
    """
    least = max(2, int(np.ceil(0.01 * len(toxic))))
    # A count by hash tells first which pieces can be frequent enough, so that only those are held.
    rough = np.zeros(1 << 22, np.int32)
    slots = lambda pieces: np.fromiter((zlib.crc32(p) for p in pieces), np.int64, len(pieces)) & (len(rough) - 1)
    for b in toxic:
        np.add.at(rough, slots(_pieces(b)), 1)
    found, other = [], Counter()
    for b in toxic:
        pieces = list(_pieces(b))
        found.append({p for p, n in zip(pieces, rough[slots(pieces)].tolist(), strict=True) if n >= least})
    counts = Counter(p for pieces in found for p in pieces)
    counts = Counter({p: k for p, k in counts.items() if k >= least})
    for b in ordinary:
        other.update(p for p in _pieces(b) if p in counts)
    gain = {}
    for p, k in counts.items():
        expected = (other[p] + 0.5) / (len(ordinary) + 1) * len(toxic)
        if k > 3 * expected:
            gain[p] = k * float(np.log(k / (expected + 0.5)))
    floor = 0.02 * max(gain.values(), default=0)
    gain = {p: g for p, g in gain.items() if g >= floor}
    holders: dict[bytes, list[int]] = {p: [] for p in gain}
    for i, pieces in enumerate(found):
        for p in pieces:
            if p in holders:
                holders[p].append(i)
    covered, out = np.zeros(len(toxic), int), []
    for p in sorted(gain, key=lambda p: (-gain[p], -len(p), p)):
        if len(out) == most or any(p.startswith(x) or x.startswith(p) for x in out):
            continue
        if (covered[holders[p]] < 2).sum() >= least:
            out.append(p)
            covered[holders[p]] += 1
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained by zstandard; too few samples are taken as they are."""
    try:
        return zstd.train_dictionary(size, samples, level=LEVEL).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def _compressors(self):
        if self._pair is None:
            # Ordinary matter is the nearer part of both, so that a window without toxic matter compresses alike.
            contents = (self.ordinary, self.toxic + self.ordinary)
            books = [zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT) for c in contents]
            for b in books:
                b.precompute_compress(level=LEVEL)
            self._pair = [zstd.ZstdCompressor(level=LEVEL, dict_data=b, write_content_size=False, write_checksum=False, write_dict_id=False) for b in books]
        return self._pair

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: windows that gain at least 1, 2, ... bytes (number, share, any), and its length."""
        parts = [windows(plain(t)) for t in texts]
        n = np.array([len(p) for p in parts])
        flat = [w for p in parts for w in p]
        gain = np.zeros(len(flat), np.int64)
        for sign, compressor in zip((1, -1), self._compressors(), strict=True):
            done = compressor.multi_compress_to_buffer(flat, threads=0)
            gain += sign * np.fromiter((len(x) for x in done), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), n)
        counts = np.stack([np.bincount(owner[gain >= k], minlength=len(texts)) for k in _STEPS], 1)
        return np.hstack((np.log1p(counts), counts / n[:, None], counts > 0, np.log(n)[:, None]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        x = (self.features(texts) - self.mean) / self.scale
        z = np.hstack((x, np.ones((len(x), 1)))) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.0005) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w, penalty = np.zeros(z.shape[1]), ridge * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (p * (1 - p))[:, None]).T @ z + len(y) * np.diag(penalty) + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + len(y) * penalty * w)
    return mean, scale, w


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model:
    """Dictionaries and calibration; ``odds`` of label 1 where the sample does not have the natural ones."""
    if not toxic or not ordinary:
        flat = np.zeros(3 * len(_STEPS) + 1)
        return Model(b" " * 8, b"\0" * 8, flat, flat + 1, np.append(flat, 2.0 if toxic else -2.0))
    bodies = [plain(t) for t in ordinary]
    pieces = toxic_pieces([plain(t) for t in toxic], bodies)
    cut = [w for b in bodies[:1500] for w in windows(b)]
    content = _trained(ORDINARY_BYTES, [cut[i] for i in np.random.default_rng(7).permutation(len(cut))[:40000]])
    # Training may leave out what few texts hold, so every piece also stands once at the near end.
    samples = [b"".join(p for p in pieces if p in t) for t in map(plain, toxic)]
    added = (_trained(TOXIC_BYTES, [x for x in samples if x]) + b"".join(reversed(pieces))) or b"\0" * 8
    raw = Model(content, added, None, None, None)
    y = np.append(np.ones(len(toxic)), np.zeros(len(ordinary)))
    mean, scale, weights = _logistic(raw.features(toxic + ordinary), y)
    if odds:
        weights[-1] += np.log(odds * len(ordinary) / len(toxic))
    return Model(content, added, mean, scale, weights)


def fold(key: str = "doc_id"):
    """True for rows held out of learning: CRC-32 of the key as text, a multiple of 5."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2000, chars: int = 20_000) -> Model:
    """A model from at most ``per_class`` labelled texts of each class of at most ``chars`` characters.

    The sample is the texts with the smallest hashes among the labelled rows that are not held out
    (``fold``); its size does not grow with the input.  Rows with a null key, label or text are not used.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1)).groupBy(key).agg(F.max("y").alias("y"))
    known = known.filter(F.col(key).isNotNull() & ~fold(key)).withColumn("h", F.xxhash64(key))
    total = known.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    sample = known.filter("y = 1").orderBy("h").limit(per_class).union(known.filter("y = 0").orderBy("h").limit(per_class))
    rows = docs.select(key, F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.octet_length("text") <= chars)).join(F.broadcast(sample), key).select("h", "y", "text").collect()
    rows.sort(key=lambda r: (r.h, r.text))
    odds = total[0] / total[1] if total[0] and total[1] else None
    return fit([r.text for r in rows if r.y == 1][:per_class], [r.text for r in rows if r.y == 0][:per_class], odds)


def _scores(batch: pa.RecordBatch, model: Model, column: str) -> np.ndarray:
    parts = slices([batch.select([column])], column, 1 << 20)
    return np.concatenate([np.empty(0), *(model.score(p.column(column).to_pylist()) for p in parts)])


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text is scored as a window without matter.  No shuffle; repeated rows are scored
    alike, an empty table stays empty.  Columns of ``docs`` named ``score`` or ``predicted`` are replaced, all others stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names, body = kept.columns, free_name(kept, "text_to_score")

    def run(batches):
        for batch in batches:
            p = _scores(batch, shared.value, body)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return kept.withColumn(body, text_or_empty(text)).mapInArrow(run, like(kept, "score double", "predicted int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body = free_name(docs, "text_to_score")

    def run(batches):
        for batch in batches:
            good = _scores(batch, shared.value, body) < 0.5
            yield batch.drop_columns([body]).filter(pa.array(good, pa.bool_()))

    return docs.withColumn(body, text_or_empty(text)).mapInArrow(run, docs.schema)
