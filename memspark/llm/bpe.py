"""Byte-level BPE in numpy: pre-tokens of a batch as ragged arrays, merged rank by rank.

A batch of texts becomes one array of code points.  Pre-token borders follow from changes of the
character class; equal pre-tokens are found by a 64-bit hash of their code points, and only those
a worker has not met before are merged.  Merging is rank-synchronous: in every round each sequence
applies its own lowest-ranked pair (every occurrence of it that does not overlap the one before),
until no sequence has a pair left.
"""

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
NONE = np.int64(1) << 40  # rank of a pair that does not merge
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, chars):
                out[low + m.start() : low + m.end()] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def border_flags(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; ``text_starts`` are the offsets of the (non-empty) texts."""
    n = len(codes)
    cls = char_classes()[codes]
    head = np.ones(n, bool)
    np.not_equal(cls[1:], cls[:-1], out=head[1:])
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    head |= first[:n]
    # The last character of white space in front of something else stands apart; a plain space joins it.
    runs = np.flatnonzero(head)
    ends = np.append(runs[1:], n)
    last = ends[(cls[runs] == SPACE) & ~first[ends]] - 1
    head[last] = True
    head[last[codes[last] == 32] + 1] = False
    # Contractions: an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll from the word behind it.
    at = np.flatnonzero((codes == 39) & head)
    at = at[at + 1 < n]
    at = at[(cls[at + 1] == LETTER) & ~first[at + 1]]
    one = codes[at + 1]
    two = np.where(first[at + 2], 0, codes[np.minimum(at + 2, n - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for taken, width in ((short, 1), (long, 2)):
        p = at[taken]
        head[p + 1] = False
        p = p + 1 + width
        head[p[p < n]] = True
    return head


@lru_cache(1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(max(5, -(-size // (1 << 18))) << 18)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span, by prefix sums of a polynomial over scrambled code points."""
    power, inverse = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_letters()[codes] * power[: len(codes)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``offset, offset + 1, ... offset + length - 1``."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(lengths.sum())


class Index:
    """Numbers distinct 64-bit keys in the order they were added (open addressing, whole arrays at a time)."""

    def __init__(self, keys: np.ndarray | None = None):
        self.size, self.bits = 0, 10
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int64)
        if keys is not None:
            self.add(keys)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for unknown ones."""
        at, mask = self._home(keys), (1 << self.bits) - 1
        out = self.number[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at, keys = at[left], keys[left]
        while len(left):
            at = (at + 1) & mask
            out[left] = self.number[at]
            on = (out[left] >= 0) & (self.keys[at] != keys)
            left, at, keys = left[on], at[on], keys[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if (self.size + len(keys)) * 2 > 1 << self.bits:
            old = np.flatnonzero(self.number >= 0)
            kept, numbers = self.keys[old], self.number[old]
            self.bits = max(self.bits, int((self.size + len(keys)) * 3).bit_length())
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.number = np.full(1 << self.bits, -1, np.int64)
            self._put(kept, numbers)
        self._put(keys, self.size + np.arange(len(keys)))
        self.size += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at, mask = self._home(keys), (1 << self.bits) - 1
        while len(keys):
            free = np.flatnonzero(self.number[at] < 0)
            self.number[at[free]] = numbers[free]
            mine = self.number[at] == numbers
            self.keys[at[mine]] = keys[mine]
            keys, numbers, at = keys[~mine], numbers[~mine], (at[~mine] + 1) & mask


class Merges:
    """A vocabulary file with its merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or [] if t.get("special")}
        # Fixed value: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.of_byte = np.array([vocab[names[b]] for b in range(256)], np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        self.pairs = Index(keys.astype(np.uint64))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.find(((left << 20) | right).astype(np.uint64))
        return np.where(found < 0, NONE, found)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, concatenated, and the number of ids of each (no word may be empty)."""
        counts = np.zeros(len(words), np.int64)
        length = np.array([len(w) for w in words], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done_symbol, done_word = [], []
        while len(symbol):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = np.full(len(symbol), NONE)
            pair = np.flatnonzero(word[1:] == word[:-1])
            rank[pair] = self.rank(symbol[pair], symbol[pair + 1])
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbol)))
            lowest = np.repeat(lowest, size)
            over = lowest == NONE
            done_symbol.append(symbol[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == lowest) & ~over)
            if not len(hit):
                break
            # Occurrences that touch (a a a): every second one of a chain is applied.
            index = np.arange(len(hit))
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            hit = hit[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        np.add.at(counts, word, 1)
        return symbol[order].astype(np.uint32), counts


class Encoder:
    """Encodes batches of texts; remembers the pre-tokens met so far, up to ``remember`` of them."""

    cut = regex.compile(r"(?<=\S) (?=\S)")  # where a text can be cut without changing its pre-tokens

    def __init__(self, path: str, remember: int = 600_000):
        self.merges = Merges(path)
        self.remember = remember
        specials = self.merges.specials
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self._forget()

    def borders(self, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        return border_flags(codes, text_starts)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pre-tokens, concatenated, and their number for each."""
        return self.merges.merge([w.encode() for w in words])

    def _forget(self) -> None:
        self.known = Index()
        self.count = np.empty(0, np.int64)
        self.offset = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _segments(self, texts: list[str], limit: int) -> tuple[list[str], list[int], list[int]]:
        """Plain segments, the text of each, and the special id it stands for (-1: none)."""
        parts, owner, special = [], [], []

        def plain(i: int, s: str) -> None:
            at = 0
            while len(s) - at > limit and (m := self.cut.search(s, at + limit)):
                parts.append(s[at : m.start()])
                owner.append(i)
                special.append(-1)
                at = m.start()
            if at < len(s):
                parts.append(s[at:])
                owner.append(i)
                special.append(-1)

        for i, s in enumerate(texts):
            at = 0
            if self.special and "<" in s:
                for m in self.special.finditer(s):
                    plain(i, s[at : m.start()])
                    parts.append(m.group())
                    owner.append(i)
                    special.append(self.merges.specials[m.group()])
                    at = m.end()
            plain(i, s[at:] if at else s)
        return parts, owner, special

    def _blocks(self, texts: list[str], limit: int):
        """Slots of the pre-tokens and the text of each, block by block."""
        parts, owner, special = self._segments(texts, limit)
        lo = 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= limit):
                size += len(parts[hi])
                hi += 1
            joined = "".join(parts[lo:hi])
            codes = code_points(joined)
            lengths = np.array([len(p) for p in parts[lo:hi]], np.int64)
            firsts = np.cumsum(lengths) - lengths
            head = self.borders(codes, firsts)
            fixed = np.array(special[lo:hi], np.int64)
            for k in np.flatnonzero(fixed >= 0):
                head[firsts[k] + 1 : firsts[k] + lengths[k]] = False
            starts = np.flatnonzero(head)
            ends = np.append(starts[1:], len(codes))
            part = np.repeat(np.arange(hi - lo), np.add.reduceat(head.astype(np.int64), firsts))
            keys = span_hashes(codes, starts, ends)
            keys = np.where(fixed[part] >= 0, mixed(fixed[part].astype(np.uint64)), keys)
            code, distinct = pd.factorize(keys)
            sample = np.empty(len(distinct), np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            slots = self._slots(distinct, joined, starts[sample], ends[sample], fixed[part[sample]])
            yield slots[code], np.array(owner[lo:hi], np.int64)[part]
            lo = hi

    def _slots(self, keys, joined, starts, ends, fixed) -> np.ndarray:
        """Slots of distinct pre-tokens; new ones are merged and remembered."""
        if self.known.size > self.remember:
            self._forget()
        found = self.known.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            plain = new[fixed[new] < 0]
            marks = new[fixed[new] >= 0]
            ids, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
            if len(plain):
                ids, counts = self.merge([joined[a:b] for a, b in zip(starts[plain].tolist(), ends[plain].tolist(), strict=True)])
            ids = np.append(ids, fixed[marks].astype(np.uint32))
            counts = np.append(counts, np.ones(len(marks), np.int64))
            self.offset = np.append(self.offset, len(self.ids) + np.cumsum(counts) - counts)
            self.count = np.append(self.count, counts)
            self.ids = np.append(self.ids, ids)
            new = np.append(plain, marks)
            found[new] = self.known.size + np.arange(len(new))
            self.known.add(keys[new])
        return found

    def counts(self, texts: list[str], limit: int = 1 << 20) -> np.ndarray:
        """Number of ids of every text."""
        out = np.zeros(len(texts), np.int64)
        for slots, owner in self._blocks(texts, limit):
            out += np.bincount(owner, self.count[slots], len(texts)).astype(np.int64)
        return out

    def encode(self, texts: list[str], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and the number of ids of each."""
        ids, counts = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
        for slots, owner in self._blocks(texts, limit):
            n = self.count[slots]
            ids.append(self.ids[ragged(self.offset[slots], n)])
            counts += np.bincount(owner, n, len(texts)).astype(np.int64)
        return np.concatenate(ids), counts


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
