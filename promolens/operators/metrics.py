"""Effects, fit, placebo, sensitivity, balance and heterogeneity of counterfactual series.

A series table has episode_id, model_type, t, treat_start, y_obs and mu0_hat; POST is t >= treat_start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["episode_id", "model_type"]


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for constant series (where `corr` fails under ANSI rules)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((a > 1e-9) & (b > 1e-9), F.covar_pop(x, y) / (a * b))


def with_effect(cf: DataFrame, from_treatment: bool = True) -> DataFrame:
    """effect and its running sum, over all periods or from treat_start on."""
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    df = cf.withColumn("effect", F.col("y_obs") - F.col("mu0_hat"))
    counted = F.when(F.col("t") >= F.col("treat_start"), F.col("effect")).otherwise(0.0) if from_treatment else F.col("effect")
    return df.withColumn("cum_effect", F.sum(counted).over(w))


def _pre(x: Column) -> Column:
    return F.when(F.col("t") < F.col("treat_start"), x)


def _post(x: Column) -> Column:
    return F.when(F.col("t") >= F.col("treat_start"), x)


def fit(cf: DataFrame, floor: float = 1.0) -> DataFrame:
    """PRE fit per episode and model: rmspe = rmse / max(floor, rms(y)), mae, corr, r2."""
    y, e = _pre(F.col("y_obs")), _pre(F.col("y_obs") - F.col("mu0_hat"))
    var = F.sum(y * y) - F.count(y) * F.pow(F.avg(y), 2)
    return cf.groupBy(*KEYS).agg(
        (F.sqrt(F.avg(e * e)) / F.greatest(F.lit(floor), F.sqrt(F.avg(y * y)))).alias("rmspe_pre"), F.avg(F.abs(e)).alias("mae_pre"),
        correlation(y, _pre(F.col("mu0_hat"))).alias("corr_pre"), F.when(var > 1e-9, 1 - F.sum(e * e) / var).alias("r2_pre"),
    )


def att(cf: DataFrame) -> DataFrame:
    e = _post(F.col("y_obs") - F.col("mu0_hat"))
    return cf.groupBy(*KEYS).agg(F.avg(e).alias("att_mean"), F.sum(e).alias("att_sum"), F.count(e).alias("n_post"))


def heterogeneity(cf: DataFrame) -> DataFrame:
    e = _post(F.col("y_obs") - F.col("mu0_hat"))
    sd, mean = F.stddev_pop(e), F.avg(e)
    return cf.groupBy(*KEYS).agg(mean.alias("tau_mean"), sd.alias("tau_sd"), F.when(F.abs(mean) > 1e-8, sd / F.abs(mean)).alias("tau_cv"), F.percentile(e, 0.5).alias("tau_median"), F.avg((e > 0).cast("int")).alias("tau_pos_share"))


def variability(cf: DataFrame) -> DataFrame:
    """Deviation over mean absolute value of observed and counterfactual series, PRE and POST."""
    cv = lambda x: F.stddev_pop(x) / (F.avg(F.abs(x)) + 1e-8)
    return cf.groupBy(*KEYS).agg(*[cv(part(F.col(c))).alias(f"cv_{n}_{p}") for p, part in (("pre", _pre), ("post", _post)) for c, n in (("y_obs", "obs"), ("mu0_hat", "cf"))])


def horizons(cf: DataFrame, lengths: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """ATT over the first periods of several lengths, and their spread."""
    e = F.col("y_obs") - F.col("mu0_hat")
    sums = [F.coalesce(F.sum(F.when((F.col("t") >= F.col("treat_start")) & (F.col("t") < F.col("treat_start") + k), e)), F.lit(0.0)).alias(f"att_{k}") for k in lengths]
    df = cf.groupBy(*KEYS).agg(*sums)
    values = [F.col(f"att_{k}") for k in lengths]
    mean = sum(values) / len(values)
    sd = F.sqrt(sum((v - mean) * (v - mean) for v in values) / len(values))
    return df.withColumns({"att_sd": sd, "att_rel_sd": F.when(F.abs(mean) > 1e-8, sd / F.abs(mean)), "att_range": F.greatest(*values) - F.least(*values)})


def sensitivity(draws: DataFrame, sample: bool = False) -> DataFrame:
    """Per episode and model over draws of att: sd, cv, range, relative sd, sign-flip rate, quantiles, robust ratio."""
    x, mean = F.col("att"), F.avg("att")
    sd = F.stddev_samp(x) if sample else F.stddev_pop(x)
    q = {p: F.percentile(x, p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    flips = F.least(F.avg((x > 0).cast("int")), F.avg((x < 0).cast("int")))
    return draws.groupBy(*KEYS).agg(
        F.count(x).alias("n"), mean.alias("mean"), sd.alias("sd"), F.when(F.abs(mean) > 1e-8, sd / F.abs(mean)).alias("cv"), (F.max(x) - F.min(x)).alias("range"), flips.alias("sign_flip_rate"),
        q[0.05].alias("q05"), q[0.5].alias("q50"), q[0.95].alias("q95"), F.when(F.abs(q[0.5]) > 1e-8, (q[0.75] - q[0.25]) / F.abs(q[0.5])).alias("robust_ratio"),
    )


def placebo(effects: DataFrame, att_table: DataFrame) -> DataFrame:
    """Placebo effects (episode_id, model_type, att) against the episode's own att_mean: p = (1 + extreme) / (1 + n)."""
    x = F.col("att")
    joined = effects.join(att_table.select(*KEYS, "att_mean"), KEYS)
    extreme = F.sum((F.abs(x) >= F.abs("att_mean") - 1e-9).cast("int"))
    return joined.groupBy(*KEYS).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), *[F.percentile(x, p).alias(n) for p, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))],
        F.avg(F.abs(x)).alias("mean_abs"), F.percentile(F.abs(x), 0.95).alias("q95_abs"), ((1 + extreme) / (1 + F.count(x))).alias("p_value"),
        F.when(F.avg(F.abs(x)) > 1e-8, F.abs(F.first("att_mean")) / F.avg(F.abs(x))).alias("effect_ratio"),
    )


def leave_one_out(effects: DataFrame) -> DataFrame:
    x = F.col("att")
    flips = F.least(F.avg((x > 0).cast("int")), F.avg((x < 0).cast("int")))
    return effects.groupBy(*KEYS).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), flips.alias("sign_flip_rate"))


def balance(rows: DataFrame, covariates: list[str], group: str = "treated_unit", pooled: str = "weighted") -> DataFrame:
    """Standardised mean difference of each covariate per episode. `weighted` pools by n - 1, `mean` takes
    the mean of both sample variances."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in covariates)
    long = rows.select("episode_id", group, F.expr(f"stack({len(covariates)}, {pairs}) as (covariate, x)"))
    side = lambda f, g: f(F.when(F.col(group) == g, F.col("x")))
    s = long.groupBy("episode_id", "covariate").agg(*[side(f, g).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    if pooled == "weighted":
        var = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2)
    else:
        var = (F.col("v1") + F.col("v0")) / 2
    return s.select("episode_id", "covariate", F.when(var > 1e-12, (F.col("m1") - F.col("m0")) / F.sqrt(var)).alias("smd"))


def balance_summary(smd: DataFrame, limit: float = 0.25) -> DataFrame:
    a = F.abs("smd")
    return smd.groupBy("episode_id").agg(F.avg(a).alias("mean_abs_smd"), F.max(a).alias("max_abs_smd"), F.sum((a > limit).cast("int")).alias("n_over"), F.avg((a <= limit).cast("int")).alias("balance_rate"))


def ols_calibration(cf: DataFrame, least: int = 5) -> DataFrame:
    """mu0_hat replaced by a + b x mu0_hat, fitted on PRE per episode; fewer than `least` points change nothing."""
    x, y = _pre(F.col("mu0_hat")), _pre(F.col("y_obs"))
    var = F.var_pop(x)
    slope = F.when(var > 1e-9, F.covar_pop(x, y) / var)
    coef = cf.groupBy(*KEYS).agg(F.count(x).alias("n"), slope.alias("b"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    ok = (F.col("n") >= least) & F.col("b").isNotNull()
    fitted = F.col("my") + F.col("b") * (F.col("mu0_hat") - F.col("mx"))
    return cf.join(coef, KEYS).withColumn("mu0_hat", F.when(ok, fitted).otherwise(F.col("mu0_hat"))).drop("n", "b", "mx", "my")


def level_calibration(cf: DataFrame, last: int = 28, trend: bool = False, cap: float = 0.04) -> DataFrame:
    """mu0_hat moved by the mean PRE residual of the last periods; with trend also by their slope, capped at
    cap x sd of y per period."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("t"))
    tail = cf.filter("t < treat_start").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= last)
    r, t = F.col("y_obs") - F.col("mu0_hat"), F.col("t").cast("double")
    coef = tail.groupBy(*KEYS).agg(F.avg(r).alias("level"), F.avg(t).alias("mt"), F.when(F.var_pop(t) > 0, F.covar_pop(t, r) / F.var_pop(t)).otherwise(0.0).alias("slope"), F.stddev_pop("y_obs").alias("sd"))
    slope = F.greatest(F.least("slope", cap * F.col("sd")), -cap * F.col("sd")) if trend else F.lit(0.0)
    moved = F.col("mu0_hat") + F.coalesce("level", F.lit(0.0)) + F.coalesce(slope * (t - F.col("mt")), F.lit(0.0))
    return cf.join(coef, KEYS, "left").withColumn("mu0_hat", moved).drop("level", "mt", "slope", "sd")


def smooth(cf: DataFrame, half: int = 1) -> DataFrame:
    """Centred moving average of mu0_hat; the edges count absent periods as 0."""
    w = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(-half, half)
    return cf.withColumn("mu0_hat", F.sum("mu0_hat").over(w) / (2 * half + 1))


def naive_did(cf: DataFrame) -> DataFrame:
    """(POST gap - PRE gap) between victim and donors, and the PRE error in percent of mean sales."""
    gap = F.col("y_obs") - F.col("mu0_hat")
    e, y = _pre(gap), _pre(F.col("y_obs"))
    return cf.groupBy(*KEYS).agg((F.avg(_post(gap)) - F.avg(e)).alias("did"), F.when(F.avg(y) > 1e-9, 100 * F.sqrt(F.avg(e * e)) / F.avg(y)).alias("rmspe_pct"))


def summary_by_model(table: DataFrame, metrics: list[str]) -> DataFrame:
    aggs = [f(F.col(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("median", lambda c: F.percentile(c, 0.5)), ("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))]
    return table.groupBy("model_type").agg(*aggs)


def merge_latest(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """left with the last row of right per key; clashing names of right get the suffix _causal."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc(order))
    one = right.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    clash = [c for c in one.columns if c in left.columns and c not in KEYS]
    return left.join(one.withColumnsRenamed({c: f"{c}_causal" for c in clash}), KEYS, "left")


def coverage(expected: DataFrame, available: DataFrame) -> DataFrame:
    """One row per model: expected, available and missing episodes."""
    models = available.select("model_type").distinct()
    want = models.withColumn("k", F.lit(1)).join(expected.select("episode_id").distinct().withColumn("k", F.lit(1)), "k").drop("k")
    have = available.select(*KEYS).distinct().withColumn("have", F.lit(1))
    return want.join(have, KEYS, "left").groupBy("model_type").agg(F.count("*").alias("expected"), F.count("have").alias("available"), F.sum(F.col("have").isNull().cast("int")).alias("missing"))


def missing_episodes(expected: DataFrame, available: DataFrame) -> DataFrame:
    return expected.select("episode_id").distinct().join(available.select("episode_id").distinct(), "episode_id", "left_anti")


def coverage_flags(episodes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per episode a 0/1 for each model with a result, and whether any has."""
    df = episodes.select("episode_id").distinct()
    for name, table in tables.items():
        df = df.join(table.select("episode_id").distinct().withColumn(name, F.lit(1)), "episode_id", "left").na.fill(0, [name])
    return df.withColumn("any", F.greatest(*[F.col(n) for n in tables], F.lit(0)))


def ecdf(table: DataFrame, value: str = "p_value") -> DataFrame:
    w = Window.partitionBy("model_type").orderBy(value)
    return table.filter(F.col(value).isNotNull()).withColumn("ecdf", F.cume_dist().over(w))


def top_by_abs(table: DataFrame, value: str, n: int) -> DataFrame:
    w = Window.partitionBy("model_type").orderBy(F.desc(F.abs(value)), "episode_id")
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def significance(placebos: DataFrame, level: float = 0.05) -> DataFrame:
    return placebos.groupBy("model_type").agg(F.avg((F.col("p_value") < level).cast("int")).alias("significant"), F.percentile("p_value", 0.5).alias("median_p"))


def placebo_noise(placebos: DataFrame) -> DataFrame:
    return placebos.groupBy("model_type").agg(F.avg("mean_abs").alias("mean_abs"), F.percentile("q95_abs", 0.5).alias("median_q95"), F.count("*").alias("n"))


def radar(report: DataFrame) -> DataFrame:
    """Five scores in 0..1 per model from medians of the report."""
    med = lambda c: F.percentile(c, 0.5)
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    m = report.groupBy("model_type").agg(*[med(c).alias(c) for c in ("rmspe_pre", "sens_rel_sd", "tau_cv", "mean_abs_smd", "p_value")])
    return m.select("model_type", clip(1 - F.col("rmspe_pre")).alias("fit"), (1 / (1 + F.col("sens_rel_sd"))).alias("stability"), clip(F.col("tau_cv") / 2).alias("heterogeneity"), clip(1 - F.col("mean_abs_smd") / 0.5).alias("balance"), F.col("p_value").alias("significance"))


def report(cf: DataFrame, rows: DataFrame, covariates: list[str], placebos: DataFrame, draws: DataFrame) -> DataFrame:
    """All metrics of each episode and model in one flat row."""
    own = att(cf)
    parts = [
        fit(cf), own, heterogeneity(cf), variability(cf),
        placebo(placebos, own).select(*KEYS, "p_value", F.col("n").alias("n_placebo"), "effect_ratio"),
        sensitivity(draws).select(*KEYS, F.col("cv").alias("sens_rel_sd"), F.col("sign_flip_rate").alias("sens_flip_rate")),
    ]
    flat = reduce(lambda a, b: a.join(b, KEYS, "left"), parts)
    return flat.join(balance_summary(balance(rows, covariates)), "episode_id", "left")
