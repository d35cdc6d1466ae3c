"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes.  Different blocks are sorted and numbered;
then pairs of neighbouring numbers are numbered in the same way, again and again, until every
text has one number.  Numbers of one round differ exactly when what they stand for differs, so no
hash can collide: texts of the same number of blocks are equal if and only if their numbers are.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import checkpointed, text_or_empty


def numbered(different: DataFrame, *by: str) -> DataFrame:
    """Number the rows of a frame without repeats in the sort order of each partition of its keys."""
    return different.sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("name"))


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 4096, row: str | None = None) -> DataFrame:
    """``row, key, sha, blocks, name``: equal texts and only these share (blocks, name)."""
    body = F.encode(text_or_empty(text), "UTF-8")
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("doc"), F.sha2(body, 256).alias("sha"), body.alias("body"),
        F.greatest(F.ceil(F.octet_length(text_or_empty(text)) / block), F.lit(1)).cast("int").alias("blocks"),
    )
    parts = rows.select("row", "doc", "sha", "blocks", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring("body", i * block + 1, F.lit(block)))).alias("pos", "part"))
    parts = parts.select("row", "blocks", "pos", "part", *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc", "sha")))
    names = numbered(parts.select("part").distinct(), "part")
    level = checkpointed(parts.join(names, "part").select("row", "doc", "sha", "blocks", "pos", "name"))
    done = level.filter("blocks = 1").select("row", "doc", "sha", "blocks", "name")
    width = 1
    longest = level.agg(F.max("blocks")).first()[0] or 1
    open_ = level.filter("blocks > 1")
    while width < longest:
        # Neighbours 2i and 2i + 1 of one text; a last one without a neighbour is paired with -1.
        pairs = open_.groupBy("row", "blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("doc").alias("doc"), F.max("sha").alias("sha"),
        )
        names = numbered(pairs.select("left", "right").distinct(), "left", "right")
        level = checkpointed(pairs.join(names, ["left", "right"]).select("row", "doc", "sha", "blocks", "pos", "name"))
        width *= 2
        ready = F.col("blocks") <= width
        done = done.union(level.filter(ready).select("row", "doc", "sha", "blocks", "name"))
        open_ = level.filter(~ready)
    return done.withColumnRenamed("doc", key)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 4096, row: str | None = None) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are compared unchanged, null as empty.  Of equal texts the row with the largest key stays
    (of rows that repeat this key too, the first one read); null keys are smaller than all others, and a group of
    null keys only has a null ``keep_id``.  Text length is not limited: each doubling is one round.

    Equal blocks are merged in the map tasks before they are numbered, groups are counted the same
    way, and both joins back to the rows can be split by adaptive execution, so a block or text that
    makes up a third of all rows does not end in one task.  Every round is a reliable checkpoint.
    ``row`` names a column of ``docs`` with a stored number for every row; the result then has it as ``row``.
    """
    found = identities(docs, key, text, block, row)
    best = F.max(F.struct(F.col(key), (-F.col("row")).alias("back")))
    groups = found.groupBy("blocks", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = found.join(groups, ["blocks", "name"]).select(
        key, F.col(f"best.{key}").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.back")).alias("kept"), F.col("sha").alias("text_sha256"), "row"
    )
    return out if row else out.drop("row")
