"""Toxicity, archives and the pipeline."""

import base64
import hashlib
import io
import os
import random
import struct
import zlib

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from memspark.llm import toxicity, warc

BAD = ["grumbo", "zanthick", "wolterish"]


def _texts(n, toxic, seed):
    rng = random.Random(seed)
    parts = ["the", "of", "and", "ma", "ne", "ti", "lor", "sha", "wen", "dri", "po"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        t = [word() for _ in range(rng.randint(20, 300))]
        if toxic:
            for _ in range(max(1, len(t) // 60)):
                t[rng.randrange(len(t))] = rng.choice(BAD)
        out.append(" ".join(t))
    return out


def test_held_out_accuracy(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in _texts(120, True, 1)] + [(t, 0) for t in _texts(500, False, 2)])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.toxicity(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").withColumn("held", toxicity.fold()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r.held]
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(60, False, 3) + _texts(20, True, 4))], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 60).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert a.toxic == b.toxic and (a.mean == b.mean).all()


@pytest.mark.parametrize("bad,good", [([], []), (["a grumbo here"], []), ([], ["plain words"]), (["x"], ["y"])])
def test_few_or_no_labels(odd, bad, good):
    model = toxicity.fit(bad, good)
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)


def test_filter_keeps_columns(odd, empty):
    model = toxicity.fit([], ["plain words"])
    kept = toxicity.keep_clean(odd, model)
    assert kept.schema == odd.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert toxicity.keep_clean(odd, toxicity.fit(["bad"], [])).count() == 0
    assert toxicity.toxicity(empty, model).count() == 0


def test_names_of_other_columns_do_not_matter(spark):
    rows = spark.createDataFrame([("plain words", "own", "kept")], "text string, __body string, text_to_score string")
    model = toxicity.fit([], ["plain words"])
    assert [tuple(r) for r in toxicity.keep_clean(rows, model).collect()] == [("plain words", "own", "kept")]
    assert tuple(toxicity.toxicity(rows, model).first())[:3] == ("plain words", "own", "kept")


PAGES = [(5, "http://a/x y", "<p>same</p>"), (3, "http://b/\r\nz", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://c", None), (2, "http://d", ""), (7, "http://e", "ü" * 200_000), (8, "http://f", "\r\n\r\nWARC/1.1\r\n"), (3, "http://b", "<p>same</p>"), (None, "http://g", "alone")]


@pytest.mark.parametrize("min_bytes,file_bytes", [(0, 64 << 20), (5, 1000)])
def test_archive(spark, tmp_path, min_bytes, file_bytes):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in PAGES], "page_id long, url string, html string, first string")
    rows = warc.archive(pages, f"{tmp_path}/w", min_bytes=min_bytes, file_bytes=file_bytes).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = min(first.get(h or "", i), i) if i is not None else first.get(h or "")
    want = set()
    for i, _, h in PAGES:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = len(body) >= min_bytes and i != first[h or ""]
        want.add((i, len(body), digest, "revisit" if revisit else "response", first[h or ""] if revisit else None))
    got = {(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in rows}
    twin = (3, 11, next(w[2] for w in want if w[0] == 3), "revisit", 3)  # one of the two rows with id 3
    assert got == want | {twin}
    assert {r.payload for r in rows if r.payload is not None} == {(h or "").encode() for _, _, h in PAGES}
    assert warc.archive(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_records_are_frames_of_their_own(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}", 64 << 20)
    records = [warc.record(i, i, f"http://x/{i}", b"<html><body>page number %d with common words</body></html>" % i) for i in range(300)]
    for r in records:
        writer.add(r)
    writer.close()
    data = (tmp_path / writer.files[0][0]).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + size]))
    rest, found = data[8 + size :], []
    while rest:
        frame = reader.decompressobj()
        found.append(frame.decompress(rest))
        rest = frame.unused_data
    assert found == records
    assert len(data) - size < sum(map(len, records)) / 2
    with pytest.raises(ValueError, match="does not begin"):
        list(warc.read_records(b"\0" * 16))
    assert io.BytesIO(data).read(4) == struct.pack("<I", 0x184D2A5D)


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    rows = [(i, t) for i, t in enumerate(_texts(60, False, 5) + _texts(30, True, 6))]
    near = rows[0][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(200, rows[1][1]), (201, rows[2][1]), (202, " ".join(near)), (203, None), (204, ""), (205, rows[3][1]), (205, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "kept", 1.0) for i, t in rows], "doc_id long, text string, row string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(60 <= i < 90)) for i in range(90)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        at = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert name == "packing" or at.schema == docs.schema
        ids.append(sorted(r.doc_id for r in at.select("doc_id").collect()))
    clean = set(range(60)) | {200, 201, 202, 203, 204, 205}
    assert len(clean - set(ids[0])) <= 2 and len(set(ids[0]) & set(range(60, 90))) <= 2
    assert ids[0].count(205) == 2 and ids[1].count(205) == 1
    assert {1, 2, 3, 203}.isdisjoint(ids[1]) and {200, 201, 204} <= set(ids[1])
    assert 202 not in ids[2] and 0 in ids[2]
    assert set(ids[3]) == set(ids[2])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(str, at.drop("sequence_id", "offset").collect()))


def test_pipeline_over_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 6
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    os.makedirs(tmp_path / "none", exist_ok=True)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
