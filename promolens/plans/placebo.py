"""Random-assignment placebo tests and parameter-grid sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import hash_order
from promolens.operators.metrics import correlation
from promolens.operators.ranks import buckets


def derive_treatment(rows: DataFrame, adopted: str = "treat_start", unit: str = "unit_id") -> DataFrame:
    """D from each unit's first adoption period; units without one are never treated."""
    first = F.min(adopted).over(Window.partitionBy("episode_id", unit))
    return rows.withColumn("D", F.coalesce((F.col("t") >= first).cast("int"), F.lit(0)))


def periods(rows: DataFrame) -> DataFrame:
    """First and last period before and after treatment, per episode."""
    pre, post = F.when(F.col("t") < F.col("treat_start"), F.col("t")), F.when(F.col("t") >= F.col("treat_start"), F.col("t"))
    return rows.groupBy("episode_id").agg(F.min(pre).alias("pre_first"), F.max(pre).alias("pre_last"), F.min(post).alias("post_first"), F.max(post).alias("post_last"))


def unit_changes(rows: DataFrame) -> DataFrame:
    """Per (episode, unit): mean sales from treat_start on less before."""
    x = F.col("unit_sales")
    return rows.groupBy("episode_id", "unit_id", "is_victim").agg(
        (F.avg(F.when(F.col("t") >= F.col("treat_start"), x)) - F.avg(F.when(F.col("t") < F.col("treat_start"), x))).alias("change")
    ).filter("change IS NOT NULL")


def assignment_test(rows: DataFrame, draws: int = 200, seed: int = 42, controls_only: bool = False) -> DataFrame:
    """Difference-in-differences against random assignments of the treatment: one grouped aggregate over
    (episode, draw). Per episode: att, p (two-sided), quantiles of the placebo effects."""
    changes = unit_changes(rows)
    own = changes.groupBy("episode_id").agg((F.avg(F.when(F.col("is_victim") == 1, F.col("change"))) - F.avg(F.when(F.col("is_victim") == 0, F.col("change")))).alias("att"))
    pool = changes.filter("is_victim = 0") if controls_only else changes
    table = pool.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy("episode_id", "draw").orderBy(hash_order(seed, F.col("episode_id"), F.col("draw"), F.col("unit_id")))
    table = table.withColumn("fake", (F.row_number().over(w) == 1).cast("int"))
    fake = table.groupBy("episode_id", "draw").agg((F.avg(F.when(F.col("fake") == 1, F.col("change"))) - F.avg(F.when(F.col("fake") == 0, F.col("change")))).alias("placebo"))
    x = F.col("placebo")
    out = fake.filter("placebo IS NOT NULL").join(own, "episode_id").groupBy("episode_id").agg(
        F.first("att").alias("att"), F.count("*").alias("n"), ((1 + F.sum((F.abs(x) >= F.abs("att") - 1e-9).cast("int"))) / (1 + F.count("*"))).alias("p_value"),
        *[F.percentile(x, p).alias(n) for p, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))],
    )
    return out


def best_of_grid(fitted: DataFrame) -> DataFrame:
    """Per episode the job with the lowest PRE error: fitted has episode_id, job_id, t, treat_start, y_obs, mu0_hat."""
    e = F.col("y_obs") - F.col("mu0_hat")
    per = fitted.groupBy("episode_id", "job_id").agg(
        F.sqrt(F.avg(F.when(F.col("t") < F.col("treat_start"), e * e))).alias("rmse_pre"), F.avg(F.when(F.col("t") >= F.col("treat_start"), e)).alias("att")
    )
    w = Window.partitionBy("episode_id").orderBy("rmse_pre", "job_id")
    return per.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def subgroup_effects(effects: DataFrame, feature: str, bins: int = 4) -> DataFrame:
    """Effects of units by quantile bins of a unit-level feature."""
    return buckets(effects, [feature, "episode_id"], bins, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.avg("att").alias("mean"), F.stddev_samp("att").alias("sd"))


def effect_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of two estimators' cell effects on their common (episode, t)."""
    both = a.select("episode_id", "t", F.col("effect").alias("x")).join(b.select("episode_id", "t", F.col("effect").alias("y")), ["episode_id", "t"])
    return both.agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("corr"))


def heterogeneity_summary(cells: DataFrame) -> DataFrame:
    """One row: mean and spread of effects by cell, by episode and by period, with quantiles."""
    by_unit, by_time = cells.groupBy("episode_id").agg(F.avg("effect").alias("a")), cells.groupBy("t").agg(F.avg("effect").alias("a"))
    k = F.lit(1)
    whole = cells.agg(F.avg("effect").alias("tau_mean"), F.stddev_samp("effect").alias("tau_sd"), F.percentile("effect", 0.25).alias("q25"), F.percentile("effect", 0.5).alias("q50"), F.percentile("effect", 0.75).alias("q75"))
    parts = [whole, by_unit.agg(F.avg("a").alias("att_i_mean"), F.stddev_samp("a").alias("att_i_sd")), by_time.agg(F.avg("a").alias("att_t_mean"), F.stddev_samp("a").alias("att_t_sd"))]
    parts = [p.withColumn("k", k) for p in parts]  # one row each
    return parts[0].join(parts[1], "k").join(parts[2], "k").withColumn("iqr", F.col("q75") - F.col("q25")).drop("k")
