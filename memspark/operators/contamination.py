"""Guard against storing protected evaluation items, by id and by content."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import tokens
from memspark.session import checkpointed, has_at_most

NGRAM = 5
CONTAINMENT = 0.8
_LIMIT = 500_000  # protected shingles that may be broadcast


def shingles(rows: DataFrame, id_col: str, text_col: str, n: int = NGRAM) -> DataFrame:
    """(id, s): the distinct word n-grams of each text; a text shorter than n words is one.

    The words are a column of their own, so that they are made once and not per n-gram.
    """
    words = rows.select(F.col(id_col), tokens(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    last = F.greatest(F.lit(1), F.size("_t") - (n - 1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("_t", i, F.lit(n)), " "))
    return words.select(id_col, F.explode(F.array_distinct(grams)).alias("s"))


def by_id(facts: DataFrame, protected: DataFrame, key: str = "fact_id") -> DataFrame:
    return facts.join(protected.select(key).distinct(), key, "left_semi")


def by_content(
    docs: DataFrame, protected: DataFrame, id_col: str, text_col: str, threshold: float = CONTAINMENT, n: int = NGRAM
) -> DataFrame:
    """(doc, item_id, share): protected items of which a document holds at least ``threshold``.

    Documents keep only protected shingles.  A document that reaches the threshold must hold one
    of the item's rarest shingles (as many as may be missing, plus one), so only those propose
    pairs: a phrase that a third of all documents share proposes none unless an item has nothing
    else.  Every proposed pair is then counted in full.
    """
    items = shingles(protected, "item_id", "text", n)
    words = shingles(docs, id_col, text_col, n).withColumnRenamed(id_col, "doc")
    guard = items.select("s").distinct()
    if has_at_most(guard, _LIMIT):
        guard = F.broadcast(guard)
    found = checkpointed(words.join(guard, "s", "left_semi"))  # used three times; the texts are read once
    spread = found.groupBy("s").agg(F.count("*").alias("_df"))
    by_item = Window.partitionBy("item_id")
    ranked = (
        items.join(spread, "s", "left").fillna(0, ["_df"])
        .withColumn("size", F.count("*").over(by_item))
        .withColumn("_pos", F.row_number().over(by_item.orderBy("_df", "s")))
    )
    needed = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    proposers = ranked.where(F.col("_pos") <= F.col("size") - needed + 1).select("item_id", "s")
    pairs = found.join(proposers, "s").select("doc", "item_id").distinct()
    counted = (
        pairs.join(items, "item_id").join(found, ["doc", "s"], "left_semi")
        .groupBy("doc", "item_id").agg(F.count("*").alias("_hits"))
    )
    size = items.groupBy("item_id").agg(F.count("*").alias("size"))
    share = F.col("_hits") / F.col("size")
    return counted.join(size, "item_id").where(F.col("_hits") >= needed).select("doc", "item_id", share.alias("share"))


def summary(events: DataFrame) -> DataFrame:
    """One row for the run report: matches, documents and items involved."""
    return events.agg(
        F.count("*").alias("matches"), F.countDistinct("doc").alias("documents"), F.countDistinct("item_id").alias("items")
    )


def check(facts: DataFrame, matches: DataFrame, mode: str = "strict") -> DataFrame:
    """``strict`` fails on any match, ``shadow`` passes the facts through."""
    if mode not in ("strict", "shadow"):
        raise ValueError(mode)
    if mode == "strict" and not matches.isEmpty():
        raise RuntimeError("a protected evaluation item would be stored")
    return facts
