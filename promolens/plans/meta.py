"""T-, S- and X-learners with forward-chaining cross-fitting on Spark ML, trained once on the whole stack."""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import clip_to_unit, counts_like
from promolens.operators.metrics import ols_calibration
from promolens.plans import boosting
from promolens.schema import UNIT


@dataclass
class Learner:
    features: list[str]
    treatment: str = "D"
    model: str = "ridge"  # ridge, forest, boosting, poisson, count_boosting
    propensity: str = "logistic"  # logistic, boosting
    weight: str = "w"
    params: dict = field(default_factory=dict)
    propensity_params: dict = field(default_factory=dict)


def time_folds(rows: DataFrame, horizon: int, k: int, embargo: int = 1) -> DataFrame:
    """(t, fold, train_before): the last k x horizon periods in blocks; a fold trains on periods before
    train_before."""
    dates = rows.select("t").distinct()
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("t")))  # one row per period
    df = dates.withColumn("n", n).filter(F.col("n") <= k * horizon)
    df = df.withColumn("fold", k - 1 - F.floor((F.col("n") - 1) / horizon)).drop("n")
    starts = df.groupBy("fold").agg((F.min("t") - embargo).alias("train_before"))
    return df.join(starts, "fold").select("t", F.col("fold").cast("int").alias("fold"), "train_before")


def unit_stats(rows: DataFrame) -> DataFrame:
    """Per unit on training rows: mean, sd, slope, means of the last 7 and 28 rows, n."""
    w = Window.partitionBy(*UNIT).orderBy(F.desc("t"))
    y, t = F.col("unit_sales"), F.col("t").cast("double")
    df = rows.withColumn("n_back", F.row_number().over(w))
    return df.groupBy(*UNIT).agg(
        F.avg(y).alias("u_mean"), F.stddev_pop(y).alias("u_sd"), (F.covar_pop(t, y) / (F.var_pop(t) + 1e-8)).alias("u_slope"),
        F.avg(F.when(F.col("n_back") <= 7, y)).alias("u_last7"), F.avg(F.when(F.col("n_back") <= 28, y)).alias("u_last28"), F.count("*").alias("u_n"),
    )


def map_stats(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """rows with their unit's statistics, or the table's mean where the unit has none."""
    whole = stats.agg(*[F.avg(n).alias(f"__{n}") for n in names]).withColumn("__k", F.lit(1))  # one row
    df = rows.join(stats.select(*UNIT, *names), UNIT, "left").withColumn("__k", F.lit(1)).join(F.broadcast(whole), "__k")
    return df.withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop("__k", *[f"__{n}" for n in names])


def sample_weights(rows: DataFrame, decay: float = 0.0) -> DataFrame:
    """w: 1 / rows of the unit x exp(-decay x age), with mean 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*UNIT))
    last = rows.agg(F.max("t").alias("__last")).withColumn("__k", F.lit(1))  # one row
    df = rows.withColumn("__k", F.lit(1)).join(F.broadcast(last), "__k").withColumn("w", F.exp(-decay * (F.col("__last") - F.col("t"))) / n)
    mean = df.agg(F.avg("w").alias("__mean")).withColumn("__k", F.lit(1))
    return df.join(F.broadcast(mean), "__k").withColumn("w", F.col("w") / F.col("__mean")).drop("__k", "__last", "__mean")


def treatment(rows: DataFrame, column: str, threshold: float = 0.0, fallback: str = "D") -> DataFrame:
    """D_bin and D_cont from a continuous column, or from the fallback where it is absent."""
    c = F.col(column if column in rows.columns else fallback)
    return rows.withColumn("D_cont", F.coalesce(c.cast("double"), F.lit(0.0))).withColumn("D_bin", (F.coalesce(c, F.lit(0)) > threshold).cast("int"))


def _regressor(spec: Learner, label: str, features: list[str]):
    common = {"labelCol": label, "predictionCol": "__p", "weightCol": spec.weight, "featuresCol": "__x"}
    stages = [VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="keep"), StandardScaler(inputCol="__raw", outputCol="__x")]
    make = {
        "ridge": lambda: LinearRegression(**({"regParam": 0.1, "elasticNetParam": 0.0} | common | spec.params)),
        "forest": lambda: RandomForestRegressor(**({"seed": 42, "numTrees": 50} | common | spec.params)),
        "boosting": lambda: GBTRegressor(**({"seed": 42, "maxIter": 30} | common | spec.params)),
        "poisson": lambda: GeneralizedLinearRegression(**({"family": "poisson", "regParam": 0.1} | common | spec.params)),
    }
    return Pipeline(stages=[*stages, make[spec.model]()])


#: models of counts, and those that stand in where the label is none
PLAIN = {"poisson": "ridge", "count_boosting": "boosting"}


def fit(train: DataFrame, spec: Learner, label: str, features: list[str] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function of (rows, name) that adds the prediction `name`. Fitted once, however many tables it is
    applied to; without varied training rows it predicts their weighted mean, or 0."""
    features = features or spec.features
    train = train.filter(F.col(label).isNotNull())
    seen = train.agg(F.count("*"), F.sum(F.col(label) * F.col(spec.weight)) / F.sum(spec.weight), F.stddev_pop(label)).first()
    if seen[0] < 10 or not seen[2]:
        return lambda to, name: to.withColumn(name, F.lit(float(seen[1] or 0.0)))
    if label != "y" and spec.model in PLAIN:
        spec = replace(spec, model=PLAIN[spec.model], params={})  # imputed effects are no counts
    if spec.model == "count_boosting":
        trees = boosting.fit(train.na.fill(0.0, features), features, label, spec.weight, boosting.Params(**spec.params))
        return lambda to, name: trees.predict(to.na.fill(0.0, features), name)
    model = _regressor(spec, label, features).fit(train.na.fill(0.0, features))
    return lambda to, name: model.transform(to.na.fill(0.0, features)).withColumnRenamed("__p", name).drop("__raw", "__x")


def propensity(train: DataFrame, to: DataFrame, spec: Learner, name: str = "p") -> DataFrame:
    """`to` with the probability of treatment within .001 and .999."""
    share = train.agg(F.avg("D_bin")).first()[0] or 0.0
    if share in (0.0, 1.0):
        return to.withColumn(name, F.lit(min(max(float(share), 0.001), 0.999)))
    cls = LogisticRegression if spec.propensity == "logistic" else GBTClassifier
    common = {"labelCol": "D_bin", "featuresCol": "__x", "weightCol": spec.weight, "predictionCol": "__c"}
    model = Pipeline(stages=[VectorAssembler(inputCols=spec.features, outputCol="__x", handleInvalid="keep"), cls(**(common | spec.propensity_params))]).fit(train.na.fill(0.0, spec.features))
    from pyspark.ml.functions import vector_to_array

    out = model.transform(to.na.fill(0.0, spec.features)).withColumn(name, vector_to_array("probability")[1])
    return out.withColumn(name, F.greatest(F.least(name, F.lit(0.999)), F.lit(0.001))).drop("__x", "__c", "rawPrediction", "probability")


def t_learner(train: DataFrame, to: DataFrame, spec: Learner) -> DataFrame:
    mu0, mu1 = (fit(train.filter(F.col("D_bin") == d), spec, "y") for d in (0, 1))
    return mu1(mu0(to, "mu0_hat"), "mu1_hat").withColumn("tau_hat", F.col("mu1_hat") - F.col("mu0_hat"))


def s_learner(train: DataFrame, to: DataFrame, spec: Learner, reference: float = 0.0) -> DataFrame:
    model = fit(train, spec, "y", [*spec.features, "D_cont"])
    out = model(to.withColumn("__d", F.col("D_cont")).withColumn("D_cont", F.lit(reference)), "mu0_hat")
    out = model(out.withColumn("D_cont", F.col("__d")), "mu1_hat").drop("__d")
    return out.withColumn("tau_hat", F.col("mu1_hat") - F.col("mu0_hat"))


def x_learner(train: DataFrame, to: DataFrame, spec: Learner, least: int = 10) -> DataFrame:
    """Effects imputed on either side, blended by the propensity: tau = p x g0 + (1 - p) x g1. With fewer than
    `least` training rows on a side, the T-learner's."""
    mu0, mu1 = (fit(train.filter(F.col("D_bin") == d), spec, "y") for d in (0, 1))
    out = mu1(mu0(to, "mu0_hat"), "mu1_hat")
    sides = train.agg(F.sum("D_bin"), F.sum(1 - F.col("D_bin"))).first()
    if min(n or 0 for n in sides) < least:
        return out.withColumn("tau_hat", F.col("mu1_hat") - F.col("mu0_hat"))
    g1 = fit(mu0(train.filter("D_bin = 1"), "__m").withColumn("d", F.col("y") - F.col("__m")), spec, "d")
    g0 = fit(mu1(train.filter("D_bin = 0"), "__m").withColumn("d", F.col("__m") - F.col("y")), spec, "d")
    out = propensity(train, g1(g0(out, "g0"), "g1"), spec)
    out = out.withColumn("tau_hat", F.col("p") * F.col("g0") + (1 - F.col("p")) * F.col("g1"))
    return out.withColumn("mu1_hat", F.col("mu0_hat") + F.col("tau_hat")).drop("g0", "g1", "p")


LEARNERS = {"T": t_learner, "S": s_learner, "X": x_learner}


KEYS, PREDICTED = ["episode_id", *UNIT, "t"], ["mu0_hat", "mu1_hat", "tau_hat"]


def fold_bounds(folds: DataFrame) -> list[tuple[int, int]]:
    """(fold, train_before) in order: k rows."""
    return sorted({(r["fold"], r["train_before"]) for r in folds.select("fold", "train_before").distinct().collect()})


def fold_predictions(rows: DataFrame, kind: str, spec: Learner, folds: DataFrame, fold: int, before: int) -> DataFrame:
    """The rows of one fold, predicted from those before it."""
    own = rows.join(folds.filter(F.col("fold") == fold).select("t"), "t", "left_semi")
    return LEARNERS[kind](rows.filter(F.col("t") < before), own, spec)


def cross_fit(rows: DataFrame, kind: str, spec: Learner, folds: DataFrame) -> DataFrame:
    """Predictions for every row: from the fold that doesn't train on it, else from the full fit."""
    parts = None
    for fold, before in fold_bounds(folds):
        done = fold_predictions(rows, kind, spec, folds, fold, before).select(*KEYS, *[F.col(n).alias(f"cf_{n}") for n in PREDICTED])
        parts = done if parts is None else parts.unionByName(done)
    full = LEARNERS[kind](rows, rows, spec)
    out = full.join(parts, KEYS, "left")
    return out.withColumns({n: F.coalesce(f"cf_{n}", n) for n in PREDICTED}).drop(*[f"cf_{n}" for n in PREDICTED])


def clip_predictions(rows: DataFrame, stats: DataFrame) -> DataFrame:
    df = rows.join(stats.select(*UNIT, "u_mean", "u_sd"), UNIT, "left")
    return df.withColumns({c: clip_to_unit(F.col(c), F.col("u_mean"), F.col("u_sd")) for c in ("mu0_hat", "mu1_hat")}).drop("u_mean", "u_sd")


def series(predicted: DataFrame, kind: str, calibrate: bool = True) -> DataFrame:
    """Victims' series of each episode, calibrated on PRE."""
    cf = predicted.filter("is_victim = 1").select("episode_id", F.lit(kind).alias("model_type"), "t", "treat_start", F.col("unit_sales").alias("y_obs"), "mu0_hat")
    return ols_calibration(cf) if calibrate else cf


def placebo_donors(predicted: DataFrame, kind: str) -> DataFrame:
    """Mean estimated effect of each donor from treat_start on."""
    d = predicted.filter("is_victim = 0 AND t BETWEEN treat_start AND post_end")
    return d.groupBy("episode_id", "unit_id").agg(F.avg("tau_hat").alias("att")).withColumn("model_type", F.lit(kind))


def placebo_time(cf: DataFrame, post: int, least: int = 2) -> DataFrame:
    """Effect over the last `post` PRE rows of each series; series with fewer than max(least, post) have none."""
    w = Window.partitionBy("episode_id", "model_type").orderBy(F.desc("t"))
    pre = cf.filter("t < treat_start").withColumn("n", F.row_number().over(w))
    out = pre.groupBy("episode_id", "model_type").agg(F.avg(F.when(F.col("n") <= post, F.col("y_obs") - F.col("mu0_hat"))).alias("att"), F.count("*").alias("n_pre"))
    return out.filter(F.col("n_pre") >= max(least, post)).drop("n_pre")


def fold_score(rows: DataFrame, kind: str, spec: Learner, folds: DataFrame, fold: int, before: int) -> float:
    """rmse / max(1, rms) on the fold's untreated rows; no rows, no error."""
    e: Column = F.col("y") - F.col("mu0_hat")
    out = fold_predictions(rows, kind, spec, folds, fold, before).filter("D_bin = 0")
    r = out.agg(F.sqrt(F.avg(e * e)), F.greatest(F.lit(1.0), F.sqrt(F.avg(F.col("y") * F.col("y"))))).first()
    return r[0] / r[1] if r[0] is not None else 0.0


def combined_score(scores: list[float]) -> float:
    """Median + 0.1 x sd over folds."""
    return statistics.median(scores) + 0.1 * statistics.pstdev(scores)


def temporal_score(rows: DataFrame, kind: str, spec: Learner, folds: DataFrame) -> float:
    return combined_score([fold_score(rows, kind, spec, folds, *bounds) for bounds in fold_bounds(folds)])


#: Name, low, high, on a log scale, whole number: what a search draws for each model
SEARCH = {
    "ridge": (("regParam", 1e-3, 10.0, True, False),),
    "poisson": (("regParam", 1e-3, 1.0, True, False),),
    "forest": (("numTrees", 10, 40, False, True), ("maxDepth", 3, 10, False, True), ("minInstancesPerNode", 1, 20, False, True)),
    "count_boosting": (("depth", 3, 6, False, True), ("rate", 0.01, 0.2, True, False), ("trees", 10, 40, False, True)),
    "boosting": (("maxDepth", 3, 8, False, True), ("stepSize", 0.01, 0.2, True, False), ("maxIter", 10, 40, False, True)),
}


def random_params(model: str, draws: int, seed: int = 42) -> list[dict]:
    """Parameter sets drawn within the bounds of SEARCH; the same for the same seed."""
    rng, out = random.Random(seed), []
    for _ in range(draws):
        drawn = {}
        for name, low, high, log, whole in SEARCH[model]:
            x = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high + (1 if whole else 0))
            drawn[name] = min(int(x), int(high)) if whole else x
        out.append(drawn)
    return out


def tune(rows: DataFrame, kind: str, spec: Learner, folds: DataFrame, candidates: list[dict], keep: float | None = None) -> tuple[dict, float]:
    """The parameter set with the lowest temporal score, and the score.

    With `keep` the folds are rungs: after each fold only that share of the sets, the best so far, goes on to the
    next, so a draw that fails on one fold costs one fit. The sets that reach the last rung have all folds' scores.
    """
    alive = {i: [] for i in range(len(candidates))}
    bounds = fold_bounds(folds)
    for rung, at in enumerate(bounds, 1):
        for i, scores in alive.items():
            scores.append(fold_score(rows, kind, replace(spec, params=candidates[i]), folds, *at))
        if keep is not None and rung < len(bounds):
            stay = sorted(alive, key=lambda i: (combined_score(alive[i]), i))[: max(1, math.ceil(len(alive) * keep))]
            alive = {i: alive[i] for i in stay}
    score, i = min((combined_score(s), i) for i, s in alive.items())
    return candidates[i], score


def for_target(rows: DataFrame, spec: Learner, label: str = "y") -> Learner:
    """spec with a model of counts where the target looks like counts: boosting with a Poisson loss, or a Poisson
    regression; forests stay."""
    counts = rows.agg(counts_like(F.col(label))).first()[0]
    return replace(spec, model={v: k for k, v in PLAIN.items()}.get(spec.model, spec.model)) if counts else spec
