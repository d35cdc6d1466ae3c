"""Line dedup: lines that occur in several documents stay in one of them.

Explode the lines, hash their keys, count documents per hash, drop the lines over the threshold and
put the rest together by position.  Built-in functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import text_or_empty

#: ASCII white space.
_ENDS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, ASCII letters in lower case."""
    return F.translate(F.btrim(line, F.lit(_ENDS)), _UPPER, _LOWER)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``key, text`` (kept lines), ``n_lines`` (before), ``n_dropped`` of every row.

    A line whose key has ``min_chars`` code points or more and occurs under ``min_docs`` different
    document ids or more is dropped, except in the smallest id that holds it (all its lines stay
    there).  A null text counts as empty, an empty text is one empty line.  Rows with a null id count
    as one more document, behind all others.  Repeated rows with one id are one document, each gives a
    row.  A document that loses every line keeps an empty text.

    Only 16-byte hashes meet in the count, summed in the map tasks first, so a line that occurs
    everywhere costs one row per task.  Lines meet the few repeated hashes in a join that adaptive
    execution can split; each row is put together from its own lines only.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), text_or_empty(text).alias("text"))
    lines = rows.select("row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("k", line_key(F.col("line")))
    # Short keys never repeat: they get a hash nobody looks for, so that they do not meet in one task.
    lines = lines.select(
        "row", "doc", "pos", "line", (F.length("k") >= min_chars).alias("long"),
        F.when(F.length("k") >= min_chars, F.unhex(F.md5("k"))).otherwise(F.unhex(F.md5(F.concat_ws(" ", "row", "pos")))).alias("hash"),
    )
    seen = lines.filter("long").select("hash", "doc")
    if min_docs <= 2:
        many = seen.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("unknown"))
        many = many.filter((F.col("first") < F.col("last")) | (F.col("unknown") & F.col("first").isNotNull()))
    else:
        many = seen.distinct().groupBy("hash").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    many = many.select("hash", "first", F.lit(True).alias("long"))
    flagged = lines.join(many, ["hash", "long"], "left")
    drop = F.coalesce(F.col("first").isNotNull() & ~F.col("doc").eqNullSafe(F.col("first")), F.lit(False))
    kept = flagged.groupBy("row").agg(
        F.first("doc").alias(key), F.count(F.lit(1)).alias("n_lines"), F.count_if(drop).alias("n_dropped"),
        F.sort_array(F.collect_list(F.when(~drop, F.struct("pos", "line")))).alias("kept"),
    )
    return kept.select(key, F.array_join(F.col("kept.line"), "\n").alias("text"), "n_lines", "n_dropped")
