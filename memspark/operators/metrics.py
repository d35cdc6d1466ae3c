"""Evaluation metrics as aggregates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark import vocab as v
from memspark.operators.percentiles import percentile_points


def hit_rate(answers: DataFrame, relevant: DataFrame, k: int, name: str = "recall_at_k") -> DataFrame:
    """One row: n_queries, n_hits, share of queries with any relevant fact among the first k."""
    good = answers.where(F.col("rank") <= k).join(relevant, ["query_id", "fact_id"], "left_semi")
    hit = good.select("query_id").distinct().withColumn("_hit", F.lit(1))
    per_query = relevant.select("query_id").distinct().join(hit, "query_id", "left")
    return per_query.agg(
        F.count("*").alias("n_queries"), F.count("_hit").alias("n_hits"),
        F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)).alias(name),
    )


def ranking_quality(answers: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, ndcg) at k with graded ``relevant(query_id, fact_id, relevance)``.

    Precision divides by k, also when fewer came back.  The ideal order takes the k best grades.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "fact_id")
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    ideal = (
        relevant.where(F.col("relevance") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .groupBy("query_id").agg(F.sum(gain).alias("_ideal"))
    )
    size = relevant.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("_n"))
    got = (
        answers.where(F.col("rank") <= k).select("query_id", "fact_id", "rank").join(relevant, ["query_id", "fact_id"])
        .groupBy("query_id").agg(F.sum(gain).alias("_dcg"), F.count_if(F.col("relevance") > 0).alias("_hits"))
    )
    zero = F.lit(0.0)
    hits = F.coalesce("_hits", F.lit(0))
    return size.join(got, "query_id", "left").join(ideal, "query_id", "left").select(
        "query_id", (hits / F.lit(k)).alias("precision"),
        F.when(F.col("_n") > 0, hits / F.col("_n")).otherwise(zero).alias("recall"),
        F.when(F.col("_ideal") > 0, F.coalesce("_dcg", zero) / F.col("_ideal")).otherwise(zero).alias("ndcg"),
    )


def class_f1(rows: DataFrame, classes: tuple[str, ...] = v.INTENTS) -> DataFrame:
    """(class, tp, fp, fn, f1) from ``rows(truth, predicted)``; a class that never occurs has f1 = 0."""
    counts = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    same = F.col("truth") == F.col("predicted")
    marks = counts.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(same, F.lit(0)).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.when(same, F.lit(0)).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )).alias("m")).select("m.*")
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    total = marks.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    full = every.join(total, "class", "left").fillna(0, ["tp", "fp", "fn"])
    wrong = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return full.withColumn("f1", F.when(wrong > 0, 2 * F.col("tp") / wrong).otherwise(F.lit(0.0)))


def macro_f1(rows: DataFrame, classes: tuple[str, ...] = v.INTENTS) -> DataFrame:
    return class_f1(rows, classes).agg(F.count("*").alias("n_classes"), F.avg("f1").alias("macro_f1"))


def extraction_quality(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """(domain, recall, precision, f1, disambiguation) from ``(domain, item, node)`` rows.

    Disambiguation: share of the correctly extracted items that were bound to the expected node.
    """
    a = extracted.dropDuplicates(["domain", "item"]).select("domain", "item", F.col("node").alias("_a"), F.lit(1).alias("_x"))
    b = expected.dropDuplicates(["domain", "item"]).select("domain", "item", F.col("node").alias("_b"), F.lit(1).alias("_e"))
    both = F.col("_x").isNotNull() & F.col("_e").isNotNull()
    t = a.join(b, ["domain", "item"], "full_outer").groupBy("domain").agg(
        F.count("_x").alias("n_x"), F.count("_e").alias("n_e"), F.count_if(both).alias("n_ok"),
        F.count_if(both & F.col("_a").eqNullSafe(F.col("_b"))).alias("n_bound"),
    )

    def ratio(x, y):
        return F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))

    return t.select(
        "domain", ratio("n_ok", "n_e").alias("recall"), ratio("n_ok", "n_x").alias("precision"),
        F.when(F.col("n_e") + F.col("n_x") > 0, 2 * F.col("n_ok") / (F.col("n_e") + F.col("n_x"))).otherwise(0.0).alias("f1"),
        ratio("n_bound", "n_ok").alias("disambiguation"),
    )


def stratified_percentiles(
    samples: DataFrame, value: str, strata: tuple[tuple[str, ...], ...], points: dict[str, float]
) -> DataFrame:
    """Percentiles per stratum, one block of rows per column set in ``strata``, all from one scan.

    A pooled number over all rows is refused: every set needs at least one column.
    """
    if not strata or any(not s for s in strata):
        raise ValueError("percentiles are only reported per stratum")
    def label(cols: tuple[str, ...]):
        parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in cols]
        return F.struct(F.lit("+".join(cols)).alias("strata"), F.concat_ws("|", *parts).alias("stratum"))

    rows = samples.where(F.col(value).isNotNull()).select(F.col(value).alias("_value"), F.inline(F.array(*map(label, strata))))
    return percentile_points(rows, "_value", points, ("strata", "stratum")).select("strata", "stratum", "n", *points)


def budget_fit(samples: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by…, n, fit_rate) of ``samples(tokens, budget)``."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("tokens") <= F.col("budget")).cast("double")).alias("fit_rate")
    )


def over_budget_tail(samples: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """p95 and p99 of the tokens above budget, among the responses that exceed it."""
    over = samples.where(F.col("tokens") > F.col("budget")).withColumn("_over", F.col("tokens") - F.col("budget"))
    return percentile_points(over, "_over", {"p95_over": 0.95, "p99_over": 0.99}, by)


def two_strata(rows: DataFrame, source: str = "source") -> DataFrame:
    """Every row in the stratum ``all``, those of the strict source classes also in ``strict``."""
    names = F.when(F.col(source).isin(*v.STRICT_SOURCES), F.array(F.lit("all"), F.lit("strict"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("stratum", F.explode(names))


def composition(cases: DataFrame, epoch: str = "v1.0") -> DataFrame:
    """(source, n, share, symmetry, violation) of ``cases(source, positive)`` against the epoch's limits.

    Symmetry is positives over negatives; a class without negatives violates it.
    """
    limits = v.COMPOSITION[epoch]
    per = cases.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("positive")).alias("_p"), F.count_if(~F.col("positive")).alias("_q")
    )
    every = cases.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in sorted(limits)])).alias("source"))
    per = every.join(per, "source", "full_outer").fillna(0, ["n", "_p", "_q"])
    total = per.agg(F.sum("n").alias("t")).scalar()
    share = F.col("n") / total
    low = high = None
    for s, (a, b) in limits.items():
        c = F.col("source") == s
        low = F.when(c, F.lit(a)) if low is None else low.when(c, F.lit(a))
        high = F.when(c, F.lit(b)) if high is None else high.when(c, F.lit(b))
    ratio = F.when(F.col("_q") > 0, F.col("_p") / F.col("_q"))
    rows = per.withColumn("share", share).withColumn("symmetry", ratio)
    violation = (
        F.when(F.col("share") < low.otherwise(F.lit(0.0)), "below_floor")
        .when(F.col("share") > high.otherwise(F.lit(1.0)), "above_cap")
        .when((F.col("n") > 0) & ~F.coalesce(F.col("symmetry").between(*v.SYMMETRY_RANGE), F.lit(False)), "asymmetric")
    )
    return rows.withColumn("violation", violation).select("source", "n", "share", "symmetry", "violation")


def set_drift(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(query_id, drift): size of the symmetric difference over the size of the expected set."""
    e = expected.select("query_id", "fact_id").distinct().withColumn("_e", F.lit(1))
    r = returned.select("query_id", "fact_id").distinct().withColumn("_r", F.lit(1))
    return (
        e.join(r, ["query_id", "fact_id"], "full_outer").groupBy("query_id")
        .agg(F.count("_e").alias("_n"), F.count_if(F.col("_e").isNull() | F.col("_r").isNull()).alias("_d"))
        .where(F.col("_n") > 0).select("query_id", (F.col("_d") / F.col("_n")).alias("drift"))
    )


def drift_alarm(drift: DataFrame, tolerance: float = 0.05, share: float = 0.10) -> DataFrame:
    """One row: probes, share of probes above ``tolerance``, and whether to investigate."""
    over = F.coalesce(F.avg((F.col("drift") > tolerance).cast("double")), F.lit(0.0))
    return drift.agg(F.count("*").alias("probes"), over.alias("over_share"), (over > share).alias("investigate"))


def agreement(live: DataFrame, shadow: DataFrame) -> DataFrame:
    """(query_id, agreement): shared facts over all facts of both answers; 1 when both are the same."""
    a = live.select("query_id", "fact_id").distinct().withColumn("_a", F.lit(1))
    b = shadow.select("query_id", "fact_id").distinct().withColumn("_b", F.lit(1))
    return a.join(b, ["query_id", "fact_id"], "full_outer").groupBy("query_id").agg(
        (F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("agreement")
    )


def retirement(prior: DataFrame, current: DataFrame, key: str = "case_id", limit: float = 0.05) -> DataFrame:
    """One row: share of the prior snapshot's cases that are gone, and the alarm."""
    gone = prior.select(key).distinct().join(current.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    ratio = F.coalesce(F.avg(F.col("_c").isNull().cast("double")), F.lit(0.0))
    return gone.agg(F.count("*").alias("n_prior"), ratio.alias("retired_share"), (ratio > limit).alias("alarm"))
