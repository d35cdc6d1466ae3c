"""A stored BM25 index whose search skips blocks.

Documents of a tenant are ordered by length and dealt into ranges of ``span`` documents; a block holds the
postings of one word in one range.  Its head carries the largest part of a score that any posting of the
block can give.  Heads are read from the blocks' files without their postings, and ``SUPER`` ranges share a coarse
head (the largest of those that each piece writes), so a search bounds every range without reading a posting:

1. coarse bounds for every query and group of ranges,
2. the ranges with the best bounds are scored, which gives a score that the k-th answer has at least,
3. only ranges whose bound reaches this score are scored; what they leave out cannot be among the first k.

The result is exact.  Searching reads no text; all tables are partitioned by a hash of (tenant, word), and
only the partitions of the words asked for are read.

Disk: a build shuffles each text once, as text, and stores each posting once; blocks are made and written where the
text is.  A search shuffles the blocks of its words by range, where their sums are local.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.functions.text import tokens
from memspark.operators import bm25
from memspark.operators.positions import positions
from memspark.session import broadcast_if, checkpointed, has_at_most

SPAN = 64  # documents of a range
SUPER = 64  # ranges with a common coarse head
BUCKETS = 64
_SLACK = 1e-6  # bounds and scores are sums in different orders; a block is skipped only if it is clearly worse
READ_LIMIT = 200_000  # entries (query and range) of a list of ranges that are sent to every task
PIECE = 500_000  # words (and documents) of a run of neighbouring ranges that is split in one task
PIECE_LIMIT = 200_000  # pieces whose first documents are sent to every task
_KEY = "_scope"
_WORD = ["bucket", _KEY, "term"]


@dataclass(frozen=True)
class TextIndex:
    """``stats(scope, n_docs, avg_len)``, ``words(scope, term, df)``, ``coarse`` and ``fine`` heads, ``blocks`` of postings;
    ``parts`` are the stored coarse heads, one for each piece that has a word in the group."""

    stats: DataFrame
    words: DataFrame
    coarse: DataFrame
    fine: DataFrame
    blocks: DataFrame
    parts: DataFrame
    by: tuple[str, ...]
    id_col: str
    buckets: int


def _scope(by: tuple[str, ...]) -> Column:
    """One text for the tenant columns; lengths keep neighbours apart."""
    if not by:
        return F.lit("")
    return F.concat(*(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in by))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(_KEY, "term"), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, *, id_col: str = "fact_id", text_col: str = "content", by: tuple[str, ...] = (), span: int = SPAN, buckets: int = BUCKETS) -> TextIndex:
    """Write the index of ``docs(by…, id, text)`` below ``path`` and open it.

    ``docs`` is read twice: once for the lengths, by which documents are numbered, once for the words.  Null and empty texts count as
    documents without words; ids are unique within a tenant.  Numbering uses sorted ranges, so a tenant with most of the documents is
    spread over the tasks, and a word that occurs everywhere has a block for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(_scope(by).alias(_KEY), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = rows.withColumn("doc_len", F.size(_words_of("text")))
    placed = positions(checkpointed(sized.drop("text")), (_KEY,), [F.col("doc_len"), F.asc_nulls_first("id")])
    placed.select(_KEY, "id", "doc_len", F.floor(F.col("pos") / span).cast("long").alias("range")).write.mode("overwrite").parquet(f"{path}/documents")
    stored = spark.read.parquet(f"{path}/documents")
    stored.groupBy(_KEY).agg(F.count("*").cast("double").alias("n_docs"), F.avg(F.col("doc_len").cast("double")).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    # Ranges meet whole in one task, so words are counted, put into blocks and written where the texts are.
    texts = _by_range(sized, stored, span).join(F.broadcast(stats) if has_at_most(stats, bm25.VOCABULARY_LIMIT) else stats, _KEY)
    split = texts.select(_KEY, "piece", "range", "id", "doc_len", "avg_len", _words_of("text").alias("w"))
    per_group = SUPER

    def per_piece(rows: pa.Table) -> pa.Table:
        return _piece_rows(rows, per_group)

    schema = "level int, " + _schema(stored.schema["id"].dataType.simpleString())
    made = split.groupBy(_KEY, "piece").applyInArrow(per_piece, schema).withColumn("slot", _bucket(buckets) * 2 + F.col("level")).drop("level")
    # Rows come by word; sorted by one number they need no comparison.
    made.sortWithinPartitions("slot").write.mode("overwrite").option("compression", "zstd").partitionBy("slot").parquet(f"{path}/parts")
    return load(spark, path, id_col=id_col, by=by, buckets=buckets)


def _piece_rows(rows: pa.Table, per_group: int) -> pa.Table:
    """The blocks of a run of ranges and their coarse heads: words are counted by document, postings sorted by word and range."""
    coded = rows["w"].combine_chunks().flatten().dictionary_encode()
    n_terms, doc = max(len(coded.dictionary), 1), np.repeat(np.arange(len(rows)), rows["doc_len"].to_numpy())
    found, tf = np.unique(doc * n_terms + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    doc, term = found // n_terms, found % n_terms
    ranges = rows["range"].to_numpy()[doc]
    order = np.lexsort((ranges, term))
    doc, term, ranges, tf = doc[order], term[order], ranges[order], tf[order].astype(np.int32)
    doc_len = rows["doc_len"].to_numpy()[doc]
    # Scopes differ in their mean length only, so the largest part is found with that of the own scope.
    part = bm25.term_score(1.0, tf.astype(np.float64), doc_len, rows["avg_len"].to_numpy()[doc], lit=float)
    starts = _starts(term, ranges)
    ends = np.append(starts, len(doc)).astype(np.int32)
    posting = pa.StructArray.from_arrays([rows["id"].combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(doc_len)], ["id", "tf", "doc_len"])
    postings = pa.ListArray.from_arrays(pa.array(ends), posting)
    term, at, top, n = term[starts], ranges[starts], _reduced(np.maximum, part, starts), np.diff(ends).astype(np.int64)
    blocks = (0, term, at, top, n, np.ones_like(n), postings)
    at = at // per_group
    starts = _starts(term, at)
    held = np.diff(np.append(starts, len(at)))
    groups = (1, term[starts], at[starts], _reduced(np.maximum, top, starts), _reduced(np.add, n, starts), held, pa.nulls(len(starts), postings.type))

    def table(level, term, at, top, n, held, postings):
        scope = rows[_KEY].combine_chunks().take(pa.array(np.zeros(len(term), np.int64)))
        return pa.table([pa.array(np.full(len(term), level, np.int32)), scope, coded.dictionary.take(pa.array(term)), *map(pa.array, (at, top, n, held)), postings], _COLUMNS)

    return pa.concat_tables([table(*blocks), table(*groups)])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted rows."""
    new = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, new)[: len(keys[0])])


def _reduced(how: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return how.reduceat(values, starts) if len(starts) else values


def _words_of(text: str) -> Column:
    return F.coalesce(tokens(F.col(text)), F.array())


def _by_range(sized: DataFrame, stored: DataFrame, span: int) -> DataFrame:
    """Texts with ``piece`` and ``range``, those of a piece in one task.

    A piece is a run of neighbouring ranges of about PIECE words.  A document finds its piece by the first one of each, and
    its range by its place in the piece, so texts are shuffled once and meet no table of all documents.
    """
    ranges = stored.groupBy(_KEY, "range").agg(F.sum(F.col("doc_len") + 1).alias("size"), F.min(F.struct("doc_len", "id")).alias("first"))
    ahead = F.sum("size").over(Window.partitionBy(_KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    cut = ranges.withColumn("piece", F.floor(F.coalesce(ahead, F.lit(0)) / PIECE)).groupBy(F.col(_KEY).alias("_k"), "piece")
    starts = cut.agg(F.min("first").alias("first"), F.min("range").alias("base"))
    pieces = checkpointed(starts.withColumn("next", F.lead("first").over(Window.partitionBy("_k").orderBy("piece"))))
    n, cores = pieces.count(), sized.sparkSession.sparkContext.defaultParallelism
    own = F.struct("doc_len", "id")
    inside = (F.col(_KEY) == F.col("_k")) & (own >= F.col("first")) & (F.col("next").isNull() | (own < F.col("next")))
    dealt = sized.join(F.broadcast(pieces) if n <= PIECE_LIMIT else pieces, inside).select(_KEY, "piece", "base", "id", "doc_len", "text")
    place = F.row_number().over(Window.partitionBy(_KEY, "piece").orderBy("doc_len", F.asc_nulls_first("id")))
    met = dealt.repartition(max(-(-n // 3), min(n, 4 * cores), 1), _KEY, "piece")
    return met.withColumn("range", F.col("base") + F.floor((place - 1) / span).cast("long"))


def _grouped(parts: DataFrame) -> DataFrame:
    """One coarse head for each word and group."""
    return parts.groupBy(*_WORD, "group").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.sum("blocks").alias("blocks"))


def _counted(parts: DataFrame) -> DataFrame:
    """The words of coarse heads."""
    return parts.groupBy(*_WORD).agg(F.sum("n").cast("double").alias("df"), F.sum("blocks").alias("blocks"))


_COLUMNS = ["level", _KEY, "term", "at", "top", "n", "blocks", "postings"]


def _schema(id_type: str) -> str:
    """Blocks (``at`` is a range, even slots) and coarse heads (``at`` is a group, odd slots) lie in one table; without rows it has no file to take this from."""
    return f"{_KEY} string, term string, at bigint, top double, n bigint, blocks bigint, postings array<struct<id:{id_type},tf:int,doc_len:int>>"


def load(spark: SparkSession, path: str, *, id_col: str = "fact_id", by: tuple[str, ...] = (), buckets: int = BUCKETS) -> TextIndex:
    """Open a stored index; ``by`` and ``buckets`` as it was built."""
    id_type = spark.read.parquet(f"{path}/documents").schema["id"].dataType.simpleString()
    rows = spark.read.schema(_schema(id_type) + ", slot int").parquet(f"{path}/parts").withColumn("bucket", F.shiftright("slot", 1))
    blocks = rows.where(F.col("slot") % 2 == 0).select(*_WORD, F.col("at").alias("range"), "top", "n", "postings")
    parts = rows.where(F.col("slot") % 2 == 1).select(*_WORD, F.col("at").alias("group"), "top", "n", "blocks")
    return TextIndex(spark.read.parquet(f"{path}/stats"), _counted(parts), _grouped(parts), blocks.drop("postings"), blocks, parts, by, id_col, buckets)


@dataclass(frozen=True)
class Found:
    """``hits`` as from ``bm25.search``; ``work(query_id, blocks, read)`` counts the blocks that hold words of a query and those scored."""

    hits: DataFrame
    work: DataFrame


def weights(index: TextIndex, queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(bucket, scope, query_id, term, w, avg_len, blocks) of the words of a query batch that the index knows."""
    scoped = queries.select(_scope(index.by).alias(_KEY), F.col(query_col).alias("query_id"), F.col(text_col).alias("text"))
    terms = bm25.query_terms(scoped, by=(_KEY,)).withColumn("bucket", _bucket(index.buckets))
    asked = broadcast_if(terms.select(*_WORD).distinct(), bm25.VOCABULARY_LIMIT)
    known = _counted(index.parts.join(asked, _WORD, "left_semi")).join(terms, _WORD).join(index.stats, _KEY)
    return known.select(
        "bucket", _KEY, "query_id", "term", (F.col("weight") * bm25.idf(F.col("n_docs"), F.col("df"))).alias("w"), "avg_len", F.col("blocks")
    )


def search(index: TextIndex, queries: DataFrame, k: int = v.FANOUT, digits: int = v.RANK_DIGITS, query_col: str = "query_id", text_col: str = "text") -> Found:
    """The first ``k`` documents for every query, ties broken by id.

    Words of a batch and lists of blocks are broadcast up to a checked number; beyond it they meet heads and blocks in a
    shuffle.  The driver receives the list of buckets, at most as many as the index has.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = checkpointed(weights(index, queries, query_col, text_col))
    small = has_at_most(asked, bm25.VOCABULARY_LIMIT)
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]
    share = lambda df: F.broadcast(df) if small else df
    pruned = lambda df: df.where(F.col("bucket").isin(wanted))
    to_words = asked.select(*_WORD, "query_id", "w")

    def bounds(met: DataFrame, unit: str) -> DataFrame:
        return met.groupBy("query_id", _KEY, unit).agg(F.sum(F.col("w") * F.col("top")).alias("bound"), F.sum("n").alias("n"))

    def ranges_of(groups: DataFrame) -> DataFrame:
        heads = pruned(index.fine).withColumn("group", F.floor(F.col("range") / SUPER).cast("long"))
        listed = broadcast_if(groups.select("query_id", _KEY, "group"), READ_LIMIT)
        return bounds(heads.join(share(to_words), _WORD).join(listed, ["query_id", _KEY, "group"], "left_semi"), "range")

    words = share(checkpointed(asked.select(*_WORD).distinct()))

    def best_of(ranges: DataFrame) -> DataFrame:
        return _top(_scores(pruned(index.blocks), share(asked.drop("blocks")), words, ranges, digits), k)

    heads = _grouped(pruned(index.parts).join(words, _WORD, "left_semi"))
    coarse = checkpointed(bounds(heads.join(share(to_words), _WORD), "group"))
    # A first answer: the group with the best bound, in it the ranges with the best bounds until they hold enough postings.
    best = coarse.groupBy("query_id", _KEY).agg(F.max_by("group", F.struct("bound", "group")).alias("group"))
    ahead = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range").rowsBetween(Window.unboundedPreceding, -1))
    first = checkpointed(ranges_of(best).withColumn("_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("_ahead") < 4 * k).select("query_id", _KEY, "range"))
    floor = best_of(first).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("_have"))
    floor = checkpointed(floor.where(F.col("_have") >= k).select("query_id", (F.col("floor") - _SLACK).alias("floor")))

    def alive(found: DataFrame) -> DataFrame:
        return found.join(share(floor), "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))

    needed = checkpointed(alive(ranges_of(alive(coarse))).select("query_id", _KEY, "range"))
    hits = best_of(needed)
    read = pruned(index.fine).join(share(to_words), _WORD).join(broadcast_if(needed, READ_LIMIT), ["query_id", _KEY, "range"], "left_semi")
    done = read.groupBy("query_id").agg(F.count("*").alias("read"))
    work = asked.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(done, "query_id", "left").fillna(0, ["read"])
    return Found(hits.select("query_id", F.col("id").alias("fact_id"), "score", F.lit("lexical").alias("source"), "rank"), work)


def _scores(blocks: DataFrame, asked: DataFrame, words: DataFrame, ranges: DataFrame, digits: int) -> DataFrame:
    """(query_id, id, score) of the documents that hold words of a query, in the ranges listed for it.

    Only blocks of ``words`` travel, to the task of their range, where all postings of a document meet: with a broadcast
    ``asked`` scores are summed there.
    """
    asking = checkpointed(ranges.groupBy(_KEY, "range").agg(F.collect_set("query_id").alias("_asking")))
    if has_at_most(ranges, READ_LIMIT):
        asking = F.broadcast(asking)
    kept = blocks.select(*_WORD, "range", "postings").join(words, _WORD, "left_semi").join(asking.select(_KEY, "range"), [_KEY, "range"], "left_semi")
    met = kept.repartition(_KEY, "range").join(asking, [_KEY, "range"]).join(asked, _WORD).where(F.array_contains("_asking", F.col("query_id")))
    each = met.select(_KEY, "range", "query_id", "w", "avg_len", F.explode("postings").alias("p"))
    part = bm25.term_score(F.col("w"), F.col("p.tf").cast("double"), F.col("p.doc_len"), F.col("avg_len"))
    return each.groupBy(_KEY, "range", "query_id", F.col("p.id").alias("id")).agg(F.round(F.sum(part), digits).alias("score")).drop(_KEY, "range")


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
