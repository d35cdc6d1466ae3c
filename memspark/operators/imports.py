"""Bulk import of an older memory tree: manifest, ids, gates, section split, backfill."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.ids import import_id
from memspark.operators.upsert import latest
from memspark.session import union_all

STATES = ("pending", "in_flight", "done", "failed", "escalated", "orphan_logged")  # fixed values
PROCEDURE_WORDS = ("procedure", "how-to", "guide", "steps", "playbook")  # fixed values
FINISHED = ("done", "escalated", "orphan_logged")


def manifest_state(entries: DataFrame, keys: tuple[str, ...] = ("source_id",), seq: str = "seq") -> DataFrame:
    return latest(entries, keys, seq)


def to_resume(entries: DataFrame, keys: tuple[str, ...] = ("source_id",), seq: str = "seq") -> DataFrame:
    """Rows a restarted run still has to process."""
    return manifest_state(entries, keys, seq).where(~F.col("status").isin(*FINISHED))


def with_ids(rows: DataFrame, ts: Column, discriminants: tuple[str, ...] = ("idem", "epi", "forget", "rollback")) -> DataFrame:
    """Adds ``<discriminant>_id`` columns for ``rows(tenant_id, source_id)``."""
    return rows.select("*", *[import_id(F.col("tenant_id"), ts, d, F.col("source_id")).alias(f"{d}_id") for d in discriminants])


def fixed_sample(rows: DataFrame, key: str, share: float, minimum: int) -> DataFrame:
    """The ``max(share * n, minimum)`` rows with the smallest key hash; the same on every run.

    Counts by the first and the next three digits of the hash find the last range that is taken in part;
    only its rows, one in 16 million, are ordered.  The counts are taken when the plan is built.
    """
    hashed = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    rest, taken, open_ = None, [], hashed
    for digits in (3, 6):
        counts = open_.groupBy(F.coalesce(F.substring("_h", 1, digits), F.lit("")).alias("p")).count().orderBy("p").collect()  # 4096 rows at most
        if rest is None:
            n = sum(r["count"] for r in counts)
            rest = min(n, max(math.ceil(share * n), minimum))
        edge = ""
        for r in counts:
            edge = r["p"]
            if r["count"] > rest:
                break
            rest -= r["count"]
        else:
            edge = "g"  # behind every hash: all rows are taken
        prefix = F.coalesce(F.substring("_h", 1, digits), F.lit(""))
        taken.append(open_.where(prefix < edge))
        open_ = open_.where(prefix == edge)
    return union_all(*taken, open_.orderBy("_h", key).limit(rest)).drop("_h")


def id_mismatches(rows: DataFrame, ts: Column, applied: str = "applied_episode_id") -> DataFrame:
    """One row for the gate: sample size and ids that differ when derived again."""
    again = import_id(F.col("tenant_id"), ts, "epi", F.col("source_id"))
    return rows.agg(F.count("*").alias("sample_size"), F.count_if(~F.col(applied).eqNullSafe(again)).alias("mismatches"))


def round_trip_failures(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest rows whose stored episode is missing, doubled, or differs in id or content.

    ``manifest(source_uri, applied_episode_id, content_hash)``, ``stored(source_uri, episode_id, content)``.
    """
    s = stored.groupBy("source_uri").agg(
        F.count("*").alias("_n"), F.min("episode_id").alias("_id"), F.min(F.sha2("content", 256)).alias("_hash")
    )
    why = (
        F.when(F.coalesce("_n", F.lit(0)) != 1, "lookup")
        .when(F.col("_id") != F.col("applied_episode_id"), "episode_id")
        .when(F.col("_hash") != F.col("content_hash"), "content")
    )
    return manifest.join(s, "source_uri", "left").withColumn("failure", why).where(F.col("failure").isNotNull()).select(
        "source_uri", "failure"
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def split_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per ``## `` heading (position, section_id, heading, body); ``root`` without headings.

    Text before the first heading belongs to no section.  The body starts with the heading line.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n## ")
    has = F.size(parts) > 1
    whole = F.array(F.struct(F.lit(0).alias("position"), F.lit(None).cast("string").alias("heading"), F.col(text_col).alias("body")))
    sections = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda p, i: F.struct(
            i.alias("position"), F.regexp_extract(p, r"^([^\n\r]*)", 1).alias("heading"), F.concat(F.lit("## "), p).alias("body")
        ),
    )
    rows = docs.withColumn("_s", F.explode(F.when(has, sections).otherwise(whole)))
    return rows.select(
        *[c for c in docs.columns if c != text_col], F.col("_s.position").alias("position"), F.col("_s.heading").alias("heading"),
        F.when(F.col("_s.heading").isNull(), "root").otherwise(slug(F.col("_s.heading"))).alias("section_id"),
        F.col("_s.body").alias("body"),
    )


def document_kind(body: Column, title: Column, tags: Column) -> Column:
    """``procedure`` for a stepwise text, else ``narrative``.

    All three are needed: three headings, a section with an ordered list of three items, and a
    word of the procedure list in the tags or the title.
    """
    headings = F.regexp_count(body, F.lit(r"(?m)^#{2,3} "))
    ordered = F.exists(
        F.split(body, r"(?m)^#{2,3} "), lambda part: F.regexp_count(part, F.lit(r"(?m)^[ \t]*\d+[.)] ")) >= 3
    )
    words = F.array(*[F.lit(w) for w in PROCEDURE_WORDS])
    tagged = F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), words)
    titled = F.exists(words, lambda w: F.contains(F.lower(F.coalesce(title, F.lit(""))), w))
    return F.when((headings >= 3) & ordered & (tagged | titled), "procedure").otherwise("narrative")


def to_reembed(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector or with one made from other text: ``nodes(node_id, content)``,
    ``vectors(node_id, content_hash)``."""
    old = vectors.select("node_id", F.col("content_hash").alias("_h"))
    return nodes.join(old, "node_id", "left").where(~F.sha2("content", 256).eqNullSafe(F.col("_h"))).drop("_h")
