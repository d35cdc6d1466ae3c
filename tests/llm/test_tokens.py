"""Token operators against the libraries' own results."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd_rows import ODD
from tokenizers import Tokenizer

from memspark.llm import bpe, packing, pieces, token_shards
from memspark.llm.token_counts import token_counts

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "th", " ", "  ", "\n", "'", "'s", "'re", "'ll", "é", "1", "23", "!", "!!", "\t", "　", "你", "😀", "<|endoftext|>", "<|", "aaaaaaaa", "²", "\r\n", "'S", "▁", "====", "<s>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def test_byte_bpe_gives_the_librarys_ids(library, random_texts):
    want = [e.ids for e in library.encode_batch(random_texts, add_special_tokens=False)]
    for limit in (1 << 20, 50):  # whole batches, and texts cut into pieces
        ids, n = bpe.Encoder(VOCABULARY).encode(random_texts, limit)
        assert ids.tolist() == [i for w in want for i in w]
        assert n.tolist() == list(map(len, want))


def test_forgetting_does_not_change_ids(random_texts):
    small = bpe.Encoder(VOCABULARY, remember=10)
    whole = bpe.Encoder(VOCABULARY)
    for at in range(0, 600, 60):
        part = random_texts[at : at + 60]
        assert small.encode(part)[0].tolist() == whole.encode(part)[0].tolist()


def test_token_counts(odd, empty, library):
    rows = [tuple(r) for r in token_counts(odd, VOCABULARY).collect()]
    want = []
    for i, t in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert token_counts(empty, VOCABULARY).count() == 0


def test_pieces_give_the_librarys_ids(random_texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder, plain = pieces.PieceEncoder(MODEL), pieces.Texts(MODEL)
    rng = random.Random(9)
    spaced = ["".join(rng.choice(["a", "the", " ", " " * rng.randint(1, 60), "\n", "▁", "é"]) for _ in range(20)) for _ in range(1000)]
    texts = [*random_texts, *spaced, "e" * 3000, "the=" * 900, *(" " * k for k in range(1, 70)), " " * 700, "a" + " " * 333 + "b"]
    ids, n = encoder.encode(texts)
    assert ids.tolist() == [i for w in model.encode(texts) for i in w]
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert plain.decode(ids[at : at + k]) == text.replace("▁", " ")
        at += k


def test_streaming_search_keeps_a_window():
    vocabulary = pieces.Pieces(MODEL)
    rng = random.Random(5)
    text = "".join(rng.choice("aeinrstohl") for _ in range(6000))
    seen = [0]

    def watch(last, real=vocabulary._converged):
        seen.append(len(last))
        return real(last)

    vocabulary._converged = watch
    found = list(vocabulary.segment(text))
    assert found == vocabulary.merged(text)
    assert "".join(found) == text and max(seen) < 20 * vocabulary.longest


def test_runs_are_joined_in_a_window():
    """What is given out never waits for more than the longest piece."""
    vocabulary = pieces.Pieces(MODEL)
    taken = 0

    def spaces():
        nonlocal taken
        for _ in range(10_000):
            taken += 1
            yield "▁"

    given = 0
    for piece in vocabulary.joined(spaces()):
        given += len(piece)
        assert taken - given <= vocabulary.longest + 1
    assert given == taken


def test_bounded_memory_does_not_change_ids(random_texts):
    small = pieces.PieceEncoder(MODEL, remember=10, remember_bytes=100)
    small.pieces.remember = 5
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(random_texts[:300])
    for limit in (1 << 18, 40):
        ids, _ = small.encode(random_texts[:300], limit)
        assert ids.tolist() == [i for w in want for i in w] and len(small.pieces._stable) <= 5


def test_names_of_other_columns_do_not_matter(spark):
    rows = spark.createDataFrame([("a b", "own", "kept", "more")], "text string, text_to_encode string, __text string, ids_to_decode string")
    done = pieces.decode(pieces.encode(rows, MODEL, decoded="again"), MODEL, text="third").first()
    assert (done.text, done.again, done.third) == ("a b",) * 3 and (done.text_to_encode, done["__text"], done.ids_to_decode) == ("own", "kept", "more")


def test_pieces_round_trip(spark, odd, empty):
    read = pieces.decode(pieces.encode(odd, MODEL), MODEL, text="again")
    assert "key" in read.columns
    assert all(r.again == (r.text or "") for r in read.collect())
    assert pieces.encode(empty, MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids binary"), MODEL).first().text is None


def _check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_pieces(odd, empty, library):
    rows = packing.packed_documents(odd, VOCABULARY).collect()
    _check_packing(rows, 2048)
    want = []
    for i, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)
    assert packing.packed_documents(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bounds_and_exchange(spark, seed):
    rng = np.random.default_rng(seed)
    size = 60
    lengths = rng.integers(1, size + 1, 400) if seed else np.full(400, 31)
    frame = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "row long, piece int, length long")
    found = packing.pack(frame, size, per_partition=40)
    assert _check_packing(found.pieces.collect(), size) == found.sequences >= found.bound
    alone = sum(len(packing.best_fit(lengths[k::10], size)[2]) for k in range(10))
    assert found.sequences <= 1.03 * alone
    if not seed:
        assert found.bound == 400  # two pieces of 31 do not fit into 60, which sums alone cannot tell


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        bins = [rng.multinomial(20 - k, np.ones(k) / k) + 1 for k in rng.integers(1, 6, 12)]  # full bins of 20
        lengths = np.concatenate(bins)
        values, counts = np.unique(lengths, return_counts=True)
        assert packing.lower_bound(values, counts, 20) == 12


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    order = token_shards.Permutation(n, 9)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.sequence(slots) == np.arange(n)).all()


def test_shards(spark, odd, empty, library, tmp_path):
    folder = f"file://{tmp_path}/shards"
    shards = token_shards.write_shards(odd, VOCABULARY, folder, length=64, shard_bytes=64 * 2 * 50)
    rows = token_shards.read_shards(spark, shards).collect()
    assert sorted(r.slot for r in rows) == list(range(shards.sequences))
    stream = np.concatenate([np.frombuffer(r.ids, shards.kind) for r in sorted(rows, key=lambda r: r.sequence_id)])
    want = [i for t in (r.text for r in odd.collect()) for i in [*library.encode(t or "", add_special_tokens=False).ids, 50256]]
    assert stream.tolist() == want
    assert token_shards.read_shards(spark, shards, 300).count() == shards.sequences - 300
    for m in shards.manifest.collect():
        data = (tmp_path / "shards" / m.file).read_bytes()
        assert len(data) == m.sequences * 128 and zlib.crc32(data) == m.crc32
    nothing = token_shards.write_shards(empty, VOCABULARY, folder + "-none")
    assert nothing.sequences == 0 and token_shards.read_shards(spark, nothing).count() == 0
