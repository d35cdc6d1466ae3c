"""Prefix tries, chat formatting and Merkle manifests against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memspark.llm import catalog, chat_format, merkle, prefix_trie

MESSAGES = "conv_id long, turn long, role string, text string, conv string, pos int, c int, head binary"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    """Messages with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "k", 1, 2, b"h") for r in rows], MESSAGES)


# --- prefix trie -------------------------------------------------------------------------------
def brute_trie(paths):
    """``paths``: list of (conv, [(role, text), ...])."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in paths:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for node, ids in members.items():
        below = [k for k in members if k[: len(node)] == node]
        kids = lambda n: [k for k in members if len(k) == len(n) + 1 and k[: len(n)] == n]
        out.append((
            least(ids), len(node), least(members[node[:-1]]) if node else None, len(ids), len(kids(node)), sum(not kids(k) for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k), sha(",".join(str(i) for i in sorted(i for i in ends[node] if i is not None))),
        ))
    return sorted(out, key=str)


def conversations(seed, n, first=0):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if t else "user", rng.choice(["yes", "nö", "", "same"])) for c in range(first, first + n) for t in range(rng.randint(1, 7))]


def paths_of(rows):
    """Turns of every conversation in the stated order; a tie is broken by the name of the turn."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        by[c].append((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}")[:32], role, text))
    return [(c, [(r, x) for *_, r, x in sorted(v)]) for c, v in by.items()]


ODD_MESSAGES = [
    (1, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 1, "", ""), (3, 1, "user", "z" * 100_000), (None, 0, "user", "a"), (None, 1, "x", "b"), (4, 0, "user", "a"), (4, 1, "x", "b"),
]


@pytest.mark.parametrize("container", [1, 3, 4096])
def test_trie_equals_brute_force(spark, container):
    rows = conversations(5, 60) + [(100 + c, t, "user", f"long {t}") for c in range(12) for t in range(30)] + [(200 + c, t, "user", f"long {min(t, 20 + c)}") for c in range(3) for t in range(25)]
    got = prefix_trie.trie(prefix_trie.sequences(frame(spark, rows)), container).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(paths_of(rows))


@pytest.mark.parametrize("container", [1, 4096])
def test_trie_of_odd_rows(spark, container):
    got = prefix_trie.trie(prefix_trie.sequences(frame(spark, ODD_MESSAGES)), container).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(paths_of(ODD_MESSAGES))


def test_trie_without_turns(spark):
    empty = prefix_trie.sequences(frame(spark, []))
    assert prefix_trie.trie(empty).count() == 0
    bare = spark.createDataFrame([(7, b"", []), (9, b"", [])], "conv long, ids binary, sizes array<long>")
    assert list(map(tuple, prefix_trie.trie(bare).collect())) == [(7, 0, None, 2, 0, 1, 0, sha("7,9"))]


def test_member_lists_are_fed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 10)
    found = prefix_trie.sequences(frame(spark, [(c, 0, "user", "all say this") for c in range(500)]))
    leaf = prefix_trie.trie(found).filter("depth = 1").first()
    assert leaf.ends_sha256 == sha(",".join(map(str, range(500)))) and leaf.n_convs == 500


def test_branches_take_the_first_turns_of_their_head(spark):
    rows = conversations(8, 33, first=3)
    own = dict(paths_of(rows))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    got = prefix_trie.trie(catalog.branched(prefix_trie.sequences(frame(spark, rows))), 2).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(list(want.items()))


# --- chat formatting ---------------------------------------------------------------------------
NASTY = ["", "\\", "\\\\l", "</turn>", "</turn>\n<turn user>\n", "\\l", "<part image 1/>", "\\<turn ", "a>\nb", "<turn \\", "\n\n", "\\### Assistant: </turn> ok", "ü" * 50_000, "</tur", "😀<|endoftext|>", "\\g\\l"]


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choice(["\\", "l", "<", "turn ", "</turn>", "<part ", "g", "\n", "é"]) for _ in range(12)) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect()
    assert all(r.u == r.t for r in got)
    assert not any(c in r.e for r in got for c in chat_format.CONTROL)


def test_format_reads_back(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)] + [(2, 5, "ass>istant\n", "x"), (2, None, None, None), (2, 5, "assistant", "y"), (2, 5, "assistant", "y"), (None, 0, "assistant", "z")]
    done = chat_format.format_chat(frame(spark, rows).withColumn("parts", chat_format.text_part(F.col("text"))))
    got = {r.conv_id: r for r in done.select("*", chat_format.turn_texts(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[: len(NASTY)]]
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("ass>istant\n", "x"), ("assistant", "y"), ("assistant", "y")]
    assert got[1].learnt == "".join(NASTY[1::2]) and got[2].learnt == "yy" and got[None].learnt == "z"
    for r in got.values():
        assert r.n_turns == len(r.turns) and r.expanded_tokens == 0 and r.attachments == []
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        blocks = r.formatted.split("</turn>\n")
        assert spans == [blocks[s.turn][s.at : s.at + s.length] for s in r.loss]


def test_parts_leave_numbered_placeholders(spark):
    part = lambda kind, text=None, **more: (kind, text, *(more.get(f) for f in ("ref", "width", "height", "seconds", "pages")))
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=57, height=28), part("text", " and <part image 9/>"), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("text", "first"), part("document", ref="c.pdf", pages=3), part("text", "then")]), (1, 2, "user", None), (1, 3, "assistant", []),
    ]
    r = chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")).select(
        "*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")
    ).first()
    assert [tuple(a) for a in r.attachments] == [(1, 0, "image", "a.png", 3), (2, 0, "audio", "b.wav", 38), (3, 1, "document", "c.pdf", 3072)]
    assert r.expanded_tokens == 3113 and r.learnt == "firstthen" and r.n_turns == 4
    assert [[tuple(p) for p in t.parts] for t in r.turns] == [
        [("text", "see ", None), ("image", None, 1), ("text", " and <part image 9/>", None), ("audio", None, 2)], [("text", "first", None), ("document", None, 3), ("text", "then", None)], [("text", "", None)], [("text", "", None)],
    ]
    assert "<part document 3/>" in r.formatted


def test_unknown_parts_fail_and_empty_tables_do_not(spark):
    bad = spark.createDataFrame([(1, 0, "user", [("video", "x")])], "conv_id long, turn long, role string, parts array<struct<type:string,text:string>>")
    with pytest.raises(Exception, match="unknown part type video"):
        chat_format.format_chat(bad).collect()
    assert chat_format.format_chat(bad.limit(0)).count() == 0


def test_formatting_stays_in_the_jvm_and_shuffles_once(spark):
    done = chat_format.format_chat(frame(spark, ODD_MESSAGES).withColumn("parts", chat_format.text_part(F.col("text"))))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# --- Merkle manifest ---------------------------------------------------------------------------
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def build(leaves):
    """(root, siblings of every leaf by level as (left, right))."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k - k % 16
            proofs[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + 16])))
        level, at = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [k // 16 for k in at]
    return level[0], proofs


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = build([x[2] for x in groups[g]])
    root, tops = build([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, r), own in zip(groups[g], trees[g][1], strict=True):
            sides = own + top
            out.append((r[0], g, leaf, trees[g][0], root, sha("".join(a + b for a, b in sides)), len(sides)))
    return sorted(out, key=str)


def documents(sizes):
    rng = random.Random(11)
    rows = [(i, s, rng.choice(["en", None]), rng.randint(0, 9), rng.choice(["Text", "", None, "ÄÖ", "x" * 3000])) for s, n in sizes.items() for i in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1, "": 2}, {"hot": 4200, "": 256, "b": 257}, {f"s{i}": 1 for i in range(300)}])
def test_manifest_equals_brute_force(spark, sizes):
    rows = documents(sizes)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, node string")
    found = merkle.manifest(docs, carry=("pos",))
    got = found.select("doc_id", "source", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), F.size("proof").alias("n"), (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), "pos").collect()
    assert all(r.ok and r.pos == 1 for r in got)
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "en", 3, "abc"), (1, "a", "en", 3, "abc"), (1, "a", "en", 3, "abd"), (2, "a", "", 0, ""), (2, "", None, -5, None), (None, "a", "é", 1, "w" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs).select("doc_id", "source", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), F.size("proof")).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_a_changed_leaf_does_not_verify(spark):
    docs = spark.createDataFrame(documents({"a": 40, "b": 3}), "doc_id long, source string, lang string, n_chars long, text string")
    changed = docs.withColumn("other", merkle.leaf("doc_id", "source", "lang", "n_chars", F.concat_ws("", "text", F.lit("!"))))
    got = merkle.manifest(changed, carry=("other",)).select((merkle.fold(F.col("other"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert len(got) == 43 and not any(r.ok for r in got)


def test_group_of_most_rows_is_spread(spark):
    """Sorting by ranges deals one group over the tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit(None).cast("string").alias("lang"), F.col("id").alias("n_chars"), F.lit("t").alias("text"))
    rows = docs.select(F.lit("g").alias("g"), merkle.leaf(*COLUMNS).alias("node"), F.col("doc_id").alias("key"))
    placed = merkle._placed(rows.repartition(8), ["key"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.groupBy("part").count().agg(F.max("count")).first()[0] < 20_000
    assert placed.filter("pos <> key or n <> 20000").isEmpty()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_chat_format", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    from crosscheck import ROOT, canonical, sql_rows

    df = catalog.QUERIES[name](spark, f"{ROOT}/sf0.001")
    cols, _, want = sql_rows(catalog.SQL[name], f"{ROOT}/sf0.001")
    got = [tuple(r) for r in df.collect()]
    assert got and canonical(df.columns, got) == canonical(cols, want)
