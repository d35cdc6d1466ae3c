"""Registry of the named queries, each next to its SQL counterpart."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame``; ``sql`` runs on the same parquet tables."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from memspark.catalog.views import Views

            return fn(Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
