"""Keyed writes on immutable tables: append with a sequence number, resolve on read.

Each resolution is an aggregate, not a sorted window: a key that holds a third of the rows is
reduced in every map task before anything is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(rows: DataFrame, keys: list[str], seq: str, chooser) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(chooser(F.struct(seq, *[c for c in rest if c != seq])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def latest(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """Insert-or-replace: the row with the highest ``seq`` per key (ties by the other columns)."""
    return _pick(rows, list(keys), seq, F.max)


def first(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """Insert-or-ignore: the row with the lowest ``seq`` per key."""
    return _pick(rows, list(keys), seq, F.min)


def split_new(incoming: DataFrame, existing: DataFrame, keys: tuple[str, ...], payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows that reuse a key with another payload)."""
    keys = list(keys)
    one = first(incoming.withColumn("_seq", F.col(payload)), tuple(keys), "_seq").drop("_seq")
    old = existing.select(*keys, F.col(payload).alias("_old"))
    to_append = one.join(old.select(*keys), keys, "left_anti")
    in_batch = one.select(*keys, F.col(payload).alias("_first"))
    diverging = (
        incoming.join(old, keys, "left").join(in_batch, keys)
        .where(F.col(payload) != F.coalesce("_old", "_first")).drop("_old", "_first")
    )
    return to_append, diverging


def counter(rows: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """Increment-by-one upserts, as a count over the appended increments."""
    return rows.groupBy(key).agg(F.count("*").alias(name))


def unexpired(rows: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    return rows.where(F.col(column) > now)


def high_water_mark(rows: DataFrame, ts: str, id_: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, ts, id) of the last row in (ts, id) order."""
    top = rows.groupBy(*by).agg(F.max(F.struct(ts, id_)).alias("_t"))
    return top.select(*by, F.col(f"_t.{ts}").alias(ts), F.col(f"_t.{id_}").alias(id_))


def after(rows: DataFrame, ts: str, id_: str, last_ts: Column, last_id: Column) -> DataFrame:
    """Rows strictly behind a cursor.  A row that arrives late, with a time before the cursor,
    is never seen; the streaming reader does not have this property."""
    return rows.where((F.col(ts) > last_ts) | ((F.col(ts) == last_ts) & (F.col(id_) > last_id)))
