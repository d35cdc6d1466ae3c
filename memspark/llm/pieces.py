"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has an edge for every vocabulary piece.  For a BPE model the weight of a path is
settled by its neighbours: a segmentation is the model's own exactly when every two
neighbouring pieces are stable, that is when merging their joined text gives the two back.  So every
position has at most one surviving backpointer.  The search keeps a window of a few times the longest
piece; whenever all surviving paths of the last window meet in one border, the ids before it are
committed and forgotten.

Neighbours settle a path as long as no two pieces have one score.  The pieces that do, runs of spaces with a score
below all others, are joined behind the search, leftmost first as the model does, in a window no longer than the longest piece.

A text is first cut where no piece holds the two characters next to each other, which no merge can
cross; equal parts are searched once per worker.
"""

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import bpe
from memspark.llm.common import free_name, like, slices, text_or_empty

_SPACE = "▁"


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(" ﬁ  x ") != f"{_SPACE * 2}ﬁ{_SPACE * 2}x{_SPACE}":
        raise ValueError("only models that keep the text and add one space in front are supported")
    return model


def _plain(model: sentencepiece.SentencePieceProcessor) -> list[int]:
    """Ids of the pieces that stand for their own text."""
    return [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class Texts:
    """The bytes every id stands for; all that decoding needs."""

    def __init__(self, path: str):
        model = _model(path)
        self.of_id = [b""] * model.get_piece_size()
        for i in _plain(model):
            self.of_id[i] = model.id_to_piece(i).replace(_SPACE, " ").encode()
        for b in range(256):
            self.of_id[model.piece_to_id(f"<0x{b:02X}>")] = bytes([b])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a document's ids; bytes that form no character become U+FFFD."""
        body = b"".join(map(self.of_id.__getitem__, ids.tolist()))
        return (body[1:] if body[:1] == b" " else body).decode("utf-8", "replace")


class Pieces:
    """Vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str, remember: int = 200_000):
        model = _model(path)
        plain = _plain(model)
        self.ids = {model.id_to_piece(i): i for i in plain}
        score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.of_byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        pairs = {(ord(a) << 21) | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.pairs = bpe.Index(np.array(sorted(pairs), np.uint64))
        # Pieces that share a score: runs of one character, behind all others.
        low = min(score.values())
        self.tied = {p for p, s in score.items() if s == low and len(p) > 1}
        if len(self.tied) < 2:
            self.tied = set()
        self.score = {p: s for p, s in score.items() if p not in self.tied}
        own = [s for p, s in self.score.items() if len(p) > 1]
        if len(set(own)) < len(own) or any(len(set(p)) > 1 for p in self.tied):
            raise ValueError("only models whose pieces of one score are runs of one character are supported")
        self.runs = {p[:2] for p in self.tied}
        # The longest piece that ends with three given characters, so that no position tries lengths in vain.
        self.reach: dict[str, int] = {}
        for p in self.score:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        self.remember = remember
        self._stable: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool | None] = {p: True if len(p) == 1 else None for p in self.score}  # None: not asked yet

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the definition: merge the best-scored pair, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, a: str, b: str) -> bool:
        found = self._stable.get((a, b))
        if found is None:
            if len(self._stable) >= self.remember:
                self._stable.clear()
            found = self._stable[a, b] = self.merged(a + b) == [a, b]
        return found

    def whole(self, a: str) -> bool:
        """True for vocabulary pieces that merging gives back as one."""
        found = self._whole.get(a, False)
        if found is None:
            found = self._whole[a] = self.merged(a) == [a]
        return found

    def segment(self, text: str):
        """Yields the pieces of a part of a text, in a window of bounded size."""
        reach, whole, stable, window = self.reach, self._whole, self._stable, 8 * self.longest
        last: list[str | None] = [""]  # piece that ends here on the surviving path; "" at a committed border
        for i in range(1, len(text) + 1):
            here = None
            n = reach.get(text[i - 3 : i], 2) if i > 2 else i
            if n > len(last):
                n = len(last)
            while n:
                before = last[-n]
                if before is not None:
                    piece = text[i - n : i]
                    good = n == 1 or whole.get(piece, False)
                    if good is None:
                        good = self.whole(piece)
                    if good and before:
                        good = stable.get((before, piece))
                        if good is None:
                            good = self.stable(before, piece)
                    if good:
                        here = piece
                        break
                n -= 1
            last.append(here)
            if len(last) > window:
                cut = self._converged(last)
                if cut:
                    yield from self._path(last, cut)
                    # The piece in front of the border still decides what may follow it.
                    last = [last[cut], *last[cut + 1 :]]
                    last[0] = last[0] or ""
        yield from self._path(last, len(last) - 1)

    def _path(self, last: list[str | None], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _converged(self, last: list[str | None]) -> int:
        """The last border that the paths to all live positions of the final window share."""
        live = [k for k in range(len(last) - self.longest, len(last)) if last[k] is not None]
        shared = None
        for k in live:
            chain = {k}
            while k > 0:
                k -= len(last[k])
                chain.add(k)
            shared = chain if shared is None else shared & chain
        return max(shared or {0})

    def joined(self, parts: Iterable[str]) -> Iterator[str]:
        """``parts`` with neighbours of one score joined, leftmost first.

        What comes first is joined before anything behind it is looked at, so only the last pieces can
        change, and only while they are together no longer than the longest piece.
        """
        last: list[str] = []
        length = 0
        for part in parts:
            last.append(part)
            length += len(part)
            while len(last) > 1 and last[-2] + last[-1] in self.tied:
                last[-2:] = [last[-2] + last[-1]]
            while length > self.longest and len(last) > 1:
                length -= len(last[0])
                yield last.pop(0)
        yield from last

    def encode(self, text: str) -> list[int]:
        """Ids of one part (see ``PieceEncoder.borders``)."""
        parts = self.segment(text)
        out = []
        for p in self.joined(parts) if any(r in text for r in self.runs) else parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.of_byte[b] for b in p.encode())
            else:
                out.append(i)
        return out


class PieceEncoder(bpe.Encoder):
    """Encodes batches of texts to SentencePiece ids."""

    cut = regex.compile(f"(?<=[^{_SPACE}]){_SPACE}(?=[^{_SPACE}])")

    def __init__(self, path: str, remember: int = 600_000, remember_bytes: int = 32 << 20):
        self.pieces, self.remember, self.remember_bytes, self.special = Pieces(path), remember, remember_bytes, None
        self._forget()

    def _slots(self, *block) -> np.ndarray:
        if self.ids.nbytes > self.remember_bytes:
            self._forget()
        return super()._slots(*block)

    def _segments(self, texts: list[str], limit: int):
        return super()._segments([_SPACE + t.replace(" ", _SPACE) if t else "" for t in texts], limit)

    def borders(self, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """True where no piece can reach across."""
        head = np.ones(len(codes), bool)
        head[1:] = self.pieces.pairs.find((codes[:-1].astype(np.uint64) << np.uint64(21)) | codes[1:].astype(np.uint64)) < 0
        head[text_starts] = True
        return head

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.pieces.encode(w) for w in words]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(2)
def texts(path: str) -> Texts:
    return Texts(path)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of every text (binary, little-endian unsigned 32-bit).

    ``model`` is the path of a SentencePiece BPE model every executor can read.  A null or empty text
    has no ids; strings like ``<s>`` in a text are ordinary text; rows that repeat are encoded each, an empty table stays
    empty.  A column ``ids`` of ``docs`` is replaced, all other columns stay as they are.  Where scores tie the leftmost pair
    is merged, as in the library.  With ``decoded`` the text that the ids decode to comes along in that column, in the same pass.

    A worker holds one batch of about 1 MB of text, cut into blocks of at most 256 K characters where parts allow; a
    longer text is cut between its parts.  What it remembers is bounded: parts in number and bytes, pairs in number.
    """
    kept = docs.drop(ids, *([decoded] if decoded else []))
    body = free_name(kept, "text_to_encode")

    def run(batches):
        for batch in slices(batches, body):
            flat, n = encoder(model).encode(batch.column(body).to_pylist(), 1 << 18)
            edge = np.cumsum(np.append(0, n))
            data = flat.astype("<u4")
            out = batch.drop_columns([body]).append_column(ids, pa.array([data[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary()))
            if decoded:
                out = out.append_column(decoded, pa.array([texts(model).decode(data[a:b]) for a, b in zip(edge, edge[1:], strict=False)], pa.string()))
            yield out

    more = [f"`{ids}` binary", *([f"`{decoded}` string"] if decoded else [])]
    return kept.withColumn(body, text_or_empty(text)).mapInArrow(run, like(kept, *more))


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of every id sequence in column ``text`` (null ids give null, no ids an empty text).

    A column ``text`` of ``rows`` is replaced, all other columns stay; rows that repeat are decoded each, an empty table stays empty.
    """
    kept = rows.drop(text)
    held = free_name(kept, "ids_to_decode")

    def run(batches):
        for batch in batches:
            found = [None if x is None else texts(model).decode(np.frombuffer(x, "<u4")) for x in batch.column(held).to_pylist()]
            yield batch.drop_columns([held]).append_column(text, pa.array(found, pa.string()))

    return kept.withColumn(held, F.col(ids)).mapInArrow(run, like(kept, f"`{text}` string"))


def checksum(ids: str = "ids"):
    """CRC-32 of the ids of a row."""
    return F.crc32(F.col(ids))


