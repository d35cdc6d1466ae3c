"""Dedup operators against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD

from memspark.llm import near_dedup
from memspark.llm.exact_dedup import exact_duplicates, identities
from memspark.llm.line_dedup import drop_repeated_lines
from memspark.llm.near_dedup import near_duplicates
from memspark.llm.vector_dedup import buckets, hadamard, near_vectors


@pytest.mark.parametrize("block", [3, 4096])
def test_exact(odd, block):
    rows = exact_duplicates(odd, block=block).collect()
    assert len(rows) == len(ODD)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in rows) == len(groups)


def test_exact_names_are_free_of_collisions(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {r.doc_id: (r.blocks, r.name) for r in identities(frame, block=1).collect()}
    assert all((names[a] == names[b]) == (texts[a] == texts[b]) for a in range(0, 400, 7) for b in range(400))


def test_exact_empty(empty):
    assert exact_duplicates(empty).count() == 0


def _lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or i == min((d for d in held[key(x)] if d is not None), default=i)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


LINES = [(1, "A repeated line \nown\nA REPEATED LINE"), (2, "\ta repeated line\nshort\nnot here"), (3, None), (4, ""), (5, "a repeated line "), (6, "short\n\n" * 500 + "once only here"), (7, "ärepeated line\nÄrepeated line"), (8, "ärepeated line"), (2, "a repeated line"), (None, "a repeated line\nno id holds this")]


def test_lines(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in LINES], "doc_id long, text string, line string")
    got = [tuple(r) for r in drop_repeated_lines(frame).collect()]
    assert sorted(got, key=str) == sorted(_lines(LINES), key=str)
    many = [tuple(r) for r in drop_repeated_lines(frame, min_docs=3).select("doc_id", "n_dropped").collect()]
    assert sum(n for _, n in many) == 3
    assert drop_repeated_lines(frame.limit(0)).count() == 0


def test_lines_stay_native(spark):
    plan = drop_repeated_lines(spark.createDataFrame(LINES, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def _near(rows, threshold=0.8, spread=0.25):
    sets = {t or "": _shingles(t) for _, t in rows}
    df = Counter(x for s in sets.values() for x in s)
    weights = {t: {x: n * (1 + spread * (1 - math.log(df[x]) / math.log(max(2, len(rows))))) for x, n in s.items()} for t, s in sets.items()}
    total = {t: sum(w.values()) for t, w in weights.items()}
    root = {t: t for t in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = list(sets)
    for k, a in enumerate(texts):
        for b in texts[:k]:
            both = sum(min(w, weights[b][x]) for x, w in weights[a].items() if x in weights[b])
            if both and both >= threshold * (total[a] + total[b] - both):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, t in rows:
        groups[find(t or "")].append(i)
    return [(i, min((x for x in groups[find(t or "")] if x is not None), default=None), len(groups[find(t or "")])) for i, t in rows]


@pytest.fixture(scope="module")
def copies():
    """A hot group of near copies with one to six words changed, smaller groups, passages shared in part, plain texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    base, passage = text(120), text(60)
    out = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = word()
        out.append(t)
    for _ in range(20):
        t = text(80)
        out += [t, [*t[:-1], word()], [*t[:40], *text(40)]]
    out += [passage + text(rng.randint(5, 60)) for _ in range(30)] + [text(4), text(3)] * 2
    rows = list(enumerate((" ".join(t) for t in out), 100)) + ODD + [(999, "One, two; THREE four five six seven!")]
    rng.shuffle(rows)
    return rows


def test_near_against_all_pairs(spark, copies):
    frame = spark.createDataFrame([(i, t, "k") for i, t in copies], "doc_id long, text string, key string")
    rows = near_duplicates(frame).collect()
    assert sorted([(r.doc_id, r.component_id, r.group_size) for r in rows], key=str) == sorted(_near(copies), key=str)
    assert sum(r.kept for r in rows) == len({r.component_id for r in rows})
    assert all(r.doc_id == r.component_id for r in rows if r.kept)


def test_near_blocks_and_pairs_agree(spark, copies):
    frame = spark.createDataFrame(copies, "doc_id long, text string")
    able = near_dedup.candidates(frame, "text", 0.8, 5, 16, 4, 0.25).cache()
    classes = []
    for large, block in ((10_000, 512), (2, 16)):  # all buckets by pairs, all in blocks
        part = near_dedup.components(near_dedup.links(able, 0.8, large, block)).collect()
        classes.append({bytes(r.node): bytes(r.component) for r in part})
    able.unpersist()
    assert classes[0] == classes[1]


def test_near_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    got = near_dedup.consistent_samples(np.append(keys, keys), np.append(a, b), np.array([0, 300]), 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def _vectors():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(6, 20)))
    rows = []
    for k, b in enumerate(base):
        rows += [b, b * 3] + [unit(b + rng.normal(size=20) * s) for s in rng.uniform(0, 0.12, 60 if k == 0 else 6)]
    rows += list(unit(rng.normal(size=(40, 20))))
    out = [(i, r.tolist()) for i, r in enumerate(rows)]
    out += [(900, None), (901, [0.0] * 20), (902, [float("nan")] * 20), (903, [1.0, None] * 10), (904, []), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (907, [float("inf")] + [0.0] * 19), (None, base[1].tolist()), (3, base[2].tolist()), (908, [1e200] * 20), (909, [1e-200] * 20)]
    return out


def test_vectors_against_all_pairs(spark):
    rows = _vectors()
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted([tuple(r) for r in near_vectors(frame).collect()], key=str)
    good = [v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good, strict=True)]
    unit = [x if x is None else x / np.linalg.norm(x) for x in unit]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    low = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        low[label[i]].append(key)
    want = []
    for i, (key, _) in enumerate(rows):
        component = min((k for k in low[label[i]] if k is not None), default=None)
        want.append((key, len(near[i]), component, key == component))
    assert got == sorted(want, key=str)
    assert near_vectors(frame.limit(0)).count() == 0


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = rng.normal(size=(2000, 64))
    z -= (z * a).sum(1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
    for hashes, least in ((2, 0.999), (3, 0.995), (4, 0.98)):
        x, y = buckets(a, 12, hashes, 3), buckets(b, 12, hashes, 3)
        assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > least


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    m = np.array([[1.0]])
    for _ in range(3):
        m = np.block([[m, m], [m, -m]])
    assert np.allclose(hadamard(x), x @ m)
