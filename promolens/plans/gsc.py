"""Synthetic control by low-rank completion, fanned out over one table of fits.

Cross-validation, placebos, leave-one-out and sensitivity are the same operator on different job
tables: a job names its episode, the unit whose periods are hidden, the units left out and the
parameters. An episode, a few dozen units by a few hundred periods, is packed into one row that its jobs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.shipping import ship_by_value
from promolens.operators.metrics import correlation, level_calibration, smooth
from promolens.sources.staging import stage

ship_by_value(__name__)

JOB = ["episode_id", "job_id"]
FITTED = "episode_id string, job_id string, unit_id string, t int, treat_start int, y_obs double, mu0_hat double, hidden int"


def soft_impute(y: np.ndarray, mask: np.ndarray, tau: float, rank: int, iterations: int = 120, tol: float = 1e-4, start: np.ndarray | None = None) -> np.ndarray:
    """Low-rank completion: fill, shrink singular values by tau, keep at most `rank`, until it settles. `start` is a
    solution near by, as of a larger tau.

    Singular values and one side's vectors come from the product with itself, units by units.
    """
    low = np.zeros_like(y) if start is None else start
    flat = y.shape[0] > y.shape[1]
    for _ in range(iterations):
        full = np.where(mask, y, low)
        full = full.T if flat else full
        values, u = np.linalg.eigh(full @ full.T)
        s, u = np.sqrt(np.maximum(values[::-1][:rank], 0.0)), u[:, ::-1][:, :rank]
        held = s > tau
        u = u[:, held]
        new = (u * (1 - tau / s[held])) @ (u.T @ full)
        new = new.T if flat else new
        moved = np.linalg.norm(new - low) / max(np.linalg.norm(low), 1e-9)
        low = new
        if moved < tol:
            break
    return low


def complete(
    y: np.ndarray, mask: np.ndarray, x: np.ndarray | None, rank: int, tau: float, alpha: float, outer: int = 10, inner: int = 120, growth: float = 1.0, cap: float = 6.0,
    tol: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None, ends: list | None = None,
) -> np.ndarray:
    """Predicted sales of every cell from the visible ones: log link, standardised, low rank plus ridge on x.
    From round to round tau and alpha grow by `growth`, to `cap` times their start at most. `start` holds the low-rank
    and the ridge part of a fit near by on the same cells; this fit's own parts are left in `ends`."""
    z = np.log1p(np.maximum(y, 0.0))
    mean, sd = z[mask].mean(), max(z[mask].std(), 1e-6)
    z = np.where(mask, (z - mean) / sd, 0.0)
    low, fixed = start or (None, np.zeros_like(z))
    fixed, last = fixed if x is not None else np.zeros_like(z), np.inf
    for i in range(outer):
        more = min(growth**i, cap)
        # a cold fit starts anew each time, a warm one goes on from where it is
        low = soft_impute(np.where(mask, z - fixed, 0.0), mask, tau * more, rank, inner, tol, low if start else None)
        if x is not None:
            a = x[mask]
            beta = np.linalg.solve(a.T @ a + alpha * more * np.eye(a.shape[1]), a.T @ (z - low)[mask])
            fixed = x @ beta
        error = float(np.sqrt(np.mean((z - low - fixed)[mask] ** 2)))
        if x is None or abs(last - error) < tol / 10:
            break
        last = error
    if ends is not None:
        ends[:] = [low, fixed]
    return np.maximum(np.expm1(np.clip((low + fixed) * sd + mean, -20, 20)), 0.0)


def train_mask(mask: np.ndarray, units: np.ndarray, periods: np.ndarray, job: pd.Series) -> np.ndarray:
    """The cells that a job trains on: not the hidden unit's (with all_rows, any unit's) periods from gap_from (else
    hide_from) to hide_to, the victim's POST periods or its last `embargo` PRE periods."""
    out = mask.copy()
    hide = (periods >= job.get("gap_from", job["hide_from"])) & (periods <= job["hide_to"])
    out[np.ix_(np.full(len(units), True) if job.get("all_rows", False) else units == job["hidden_unit"], hide)] = False
    own = np.flatnonzero(mask[units == job["victim"]].any(axis=0) & (periods < job["treat_start"]))
    late = periods >= job["treat_start"]
    late[own[len(own) - min(int(job.get("embargo", 0)), len(own)) :]] = True
    out[np.ix_(units == job["victim"], late)] = False
    return out


def fit_job(y: np.ndarray, present: np.ndarray, units: np.ndarray, periods: np.ndarray, job: pd.Series, start: tuple | None = None, ends: list | None = None) -> pd.DataFrame | None:
    """The fitted series of one job on an episode's matrix, units by periods; None where it has nothing to learn from."""
    stay = units != job["excluded_unit"]
    seen_at = present[stay].any(axis=0)
    y, mask, units, periods = y[stay][:, seen_at], present[stay][:, seen_at], units[stay], periods[seen_at]
    row = np.flatnonzero(units == job["hidden_unit"])
    if not len(row):
        return None
    hide = (periods >= job["hide_from"]) & (periods <= job["hide_to"])
    gap = (periods >= job.get("gap_from", job["hide_from"])) & (periods < job["hide_from"])
    seen = train_mask(mask, units, periods, job)
    if not seen[row[0]].any() or seen.sum() < 4:
        return None
    x = None
    if job["covariates"]:
        year = 2 * np.pi * periods / 12.0
        x = np.stack([np.broadcast_to(c, y.shape) for c in (np.sin(year), np.cos(year), (periods - periods.mean()) / max(periods.std(), 1))], axis=2)
    schedule = {k: kind(job[k]) for k, kind in (("inner", int), ("growth", float), ("cap", float), ("tol", float)) if k in job}
    fitted = complete(y, seen, x, int(min(job["rank"], *y.shape)), float(job["tau"]), float(job["alpha"]), **schedule, start=start, ends=ends)
    at = row[0]
    return pd.DataFrame({"episode_id": job["episode_id"], "job_id": job["job_id"], "unit_id": units[at], "t": periods.astype("int32"), "treat_start": np.int32(job["treat_start"]), "y_obs": np.where(mask[at], y[at], np.nan), "mu0_hat": fitted[at], "hidden": np.where(hide, 1, np.where(gap, 2, 0)).astype("int32")})


#: What jobs of one path have in common, besides the unit and the periods they hide.
PATH = ["hidden_unit", "excluded_unit", "hide_from", "hide_to", "gap_from", "all_rows", "embargo", "rank", "covariates", "growth", "cap"]


def fit_episode(units: np.ndarray, periods: np.ndarray, values: np.ndarray, jobs: pd.DataFrame, warm: bool) -> list[pd.DataFrame]:
    """All jobs of one episode, whose cells are given as (unit, period, value) in three arrays; several values of a
    cell are added up. With `warm`, jobs that differ in tau and alpha only start from the one with the next larger tau."""
    names, i = np.unique(units, return_inverse=True)
    times, j = np.unique(periods, return_inverse=True)
    y, present = np.zeros((len(names), len(times))), np.zeros((len(names), len(times)), bool)
    np.add.at(y, (i, j), np.nan_to_num(values))
    present[i, j] = True
    if not warm:
        return [d for _, job in jobs.iterrows() if (d := fit_job(y, present, names, times, job)) is not None]
    out = []
    for _, path in jobs.groupby([c for c in PATH if c in jobs], dropna=False, sort=False):
        start = None
        for _, job in path.sort_values(["tau", "job_id"], ascending=[False, True]).iterrows():
            ends: list = []
            if (d := fit_job(y, present, names, times, job, start, ends)) is not None:
                out.append(d)
                start = tuple(ends)
    return out


def fits(rows: DataFrame, jobs: DataFrame, warm: bool = False, slots: int = 8) -> DataFrame:
    """Fitted series of each job's hidden unit; hidden is 1 in the periods it doesn't see, 2 in the gap before them. jobs: episode_id, job_id, hidden_unit, hide_from, hide_to,
    excluded_unit, rank, tau, alpha, covariates; and, where wanted, gap_from, all_rows, embargo, inner, growth, cap, tol.

    An episode is packed into one row, and its jobs into at most `slots` rows that meet it: cells are shuffled once, however
    many jobs there are. Jobs of one path share a slot.
    """
    victims = rows.filter("is_victim = 1").groupBy("episode_id").agg(F.first("unit_id").alias("victim"))
    cells = F.array_sort(F.collect_list(F.struct("unit_id", "t", "unit_sales")))
    packed = rows.groupBy("episode_id").agg(F.min("treat_start").alias("treat_start"), cells.alias("c")).join(victims, "episode_id")
    packed = packed.select("episode_id", "treat_start", "victim", F.col("c.unit_id").alias("units"), F.col("c.t").alias("periods"), F.col("c.unit_sales").cast("array<double>").alias("values"))
    packed = packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    own = [c for c in jobs.columns if c not in ("episode_id", "treat_start")]
    slot = F.pmod(F.xxhash64(*([c for c in PATH if c in own] if warm else ["job_id"])), F.lit(slots)).cast("int")
    # fits cost far more than their rows tell: as many tasks as shuffles have partitions, never fewer
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = jobs.withColumn("slot", slot).repartition(parts, "episode_id", "slot").groupBy("episode_id", "slot").agg(F.sort_array(F.collect_list(F.struct("job_id", *[c for c in own if c != "job_id"]))).alias("jobs"))
    work = lists.join(packed, ["episode_id", "slot"]).drop("slot")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, e in batch.iterrows():
                todo = pd.DataFrame([dict(j) if isinstance(j, dict) else j.asDict() for j in e["jobs"]]).assign(episode_id=e["episode_id"], treat_start=e["treat_start"], victim=e["victim"])
                for done in fit_episode(np.asarray(e["units"], object), np.asarray(e["periods"], int), np.asarray(e["values"], float), todo, warm):
                    yield done

    return work.mapInPandas(run, FITTED)


def scales(rows: DataFrame) -> DataFrame:
    """Leading singular value of each episode's standardised log PRE block, the scale of tau."""

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.log1p(np.maximum(pdf.pivot_table(index="unit_id", columns="t", values="unit_sales", aggfunc="sum").fillna(0.0).to_numpy(float), 0))
        s = np.linalg.svd((z - z.mean()) / max(z.std(), 1e-6), compute_uv=False)[0]
        return pd.DataFrame({"episode_id": [pdf["episode_id"].iloc[0]], "scale": [float(s)]})

    return rows.filter("is_pre = 1").select("episode_id", "unit_id", "t", "unit_sales").groupBy("episode_id").applyInPandas(leading, "episode_id string, scale double")


def _victims(rows: DataFrame) -> DataFrame:
    return rows.filter("is_victim = 1").groupBy("episode_id").agg(F.first("unit_id").alias("hidden_unit"), F.min("treat_start").alias("treat_start"), F.max("t").alias("last_t"))


def grid(rows: DataFrame, ranks: tuple[int, ...] = (1, 2), taus: tuple[float, ...] = (0.05, 0.2), alphas: tuple[float, ...] = (0.01,)) -> DataFrame:
    """Specifications per episode: every rank x share of the episode's scale x ridge strength."""
    specs = F.array(*[F.struct(F.lit(f"r{r}_t{t}_a{a}").alias("spec_id"), F.lit(r).alias("rank"), F.lit(t).alias("share"), F.lit(a).alias("alpha")) for r in ranks for t in taus for a in alphas])
    df = scales(rows).withColumn("s", F.explode(specs))
    return df.select("episode_id", "s.spec_id", "s.rank", (F.col("s.share") * F.col("scale")).alias("tau"), "s.alpha", F.lit(True).alias("covariates"))


def random_specs(rows: DataFrame, draws: int, seed: int = 42, max_rank: int = 5, tau: tuple[float, float] = (0.05, 0.8), alpha: tuple[float, float] = (1e-4, 1e-2), schedule: bool = False) -> DataFrame:
    """Random specifications per episode from seeded hashes: rank uniform, tau (as a share of the scale) and alpha
    log-uniform, covariates on or off; with schedule also the inner rounds and the growth of both penalties."""
    df = scales(rows).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def u(name: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", "episode_id", "draw", F.lit(name), F.lit(seed))), 1, 8), 16, 10).cast("double") / float(2**32)

    log_uniform = lambda lo, hi, x: F.exp(np.log(lo) + x * float(np.log(hi / lo)))
    more = [(60 + F.floor(u("inner") * 141)).cast("int").alias("inner"), (1 + 0.25 * u("growth")).alias("growth"), (1 + 2 * u("cap")).alias("cap")] if schedule else []
    return df.select(
        "episode_id", F.concat(F.lit("d"), F.col("draw")).alias("spec_id"), (1 + F.floor(u("rank") * max_rank)).cast("int").alias("rank"),
        (log_uniform(*tau, u("tau")) * F.col("scale")).alias("tau"), log_uniform(*alpha, u("alpha")).alias("alpha"), (u("x") < 0.5).alias("covariates"), *more,
    )


def folds(rows: DataFrame, horizon: int = 3, gap: int = 1, k: int = 3) -> DataFrame:
    """Rolling folds inside each PRE window: (episode_id, fold_id, gap_from, hide_from, hide_to), the last periods
    always. Training leaves out the gap before a fold's periods too."""
    pre = rows.filter("is_victim = 1 AND is_pre = 1").groupBy("episode_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    least = max(2, horizon)
    span = F.col("b") - F.col("a") + 1 - (least + gap + horizon)
    step = F.greatest(F.floor(span / k), F.lit(1))
    starts = F.when(span >= 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("a") + least + gap + i * step)).otherwise(F.array(F.col("b") - horizon + 1))
    last = F.col("b") - horizon + 1
    df = pre.withColumn("h", F.explode(F.array_distinct(F.concat(F.transform(starts, lambda x: F.least(x, last).cast("long")), F.array(last.cast("long"))))))
    df = df.filter((F.col("h") - F.lit(gap) - F.col("a")) >= 1)
    return df.select("episode_id", F.concat(F.lit("f"), F.col("h")).alias("fold_id"), (F.col("h") - gap).cast("int").alias("gap_from"), F.col("h").cast("int").alias("hide_from"), (F.col("h") + horizon - 1).cast("int").alias("hide_to"))


def holdout_mask(rows: DataFrame, fold_table: DataFrame, all_rows: bool = False) -> DataFrame:
    """rows by fold with train_mask: 0 where a fold hides the cell (its gap and its periods, of the victim or of all
    units) and in the victim's POST periods."""
    df = rows.join(fold_table, "episode_id")
    hidden = F.col("t").between(F.col("gap_from"), F.col("hide_to")) & (F.lit(True) if all_rows else F.col("is_victim") == 1)
    late = (F.col("is_victim") == 1) & (F.col("t") >= F.col("treat_start"))
    return df.withColumn("train_mask", (~(hidden | late)).cast("int"))


def _jobs(specs: DataFrame, targets: DataFrame, *names: str) -> DataFrame:
    return specs.join(targets, "episode_id").withColumn("job_id", F.concat_ws("|", *names))


def _fold_rows(fitted: DataFrame) -> DataFrame:
    """Per (episode, job) what a search looks at, on the hidden periods (hold) and on all of PRE (pre)."""
    y, m = F.col("y_obs"), F.col("mu0_hat")
    d = F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(m)
    by_time = Window.partitionBy(*JOB).orderBy("t")
    inside = Window.partitionBy(*JOB, "hidden").orderBy("t")
    pre = fitted.filter("t < treat_start AND y_obs IS NOT NULL").withColumns({
        "d2": d * d, "e2": (y - m) * (y - m), "q95": F.percentile("y_obs", 0.95).over(Window.partitionBy(*JOB)),
        "dy": y - F.lag(y).over(by_time), "dm": m - F.lag(m).over(by_time), "hy": y - F.lag(y).over(inside), "hm": m - F.lag(m).over(inside),
    })
    hold = lambda c: F.when(F.col("hidden") == 1, c)
    train = lambda c: F.when((F.col("hidden") == 0) & (F.col("t") < F.col("first_hidden")), c)
    spread = lambda c: F.stddev_pop(c) / (F.avg(F.abs(c)) + 1e-8)

    def ratio(a: Column, b: Column, least: float) -> Column:
        return F.when(b > least, a / (b + 1e-8)).otherwise(F.lit(1.0))

    # fixed values: beyond three times the 95th percentile, or beyond 10 where that is 0
    excess = F.when(F.col("q95") > 0, F.greatest(m - 3 * F.col("q95"), F.lit(0.0)) / (F.col("q95") + 1e-8))
    largest = F.max(F.when(F.col("q95") <= 0, F.greatest(m - 10, F.lit(0.0)) / 10))
    pre = pre.withColumn("first_hidden", F.min(hold(F.col("t"))).over(Window.partitionBy(*JOB)))
    return pre.groupBy(*JOB).agg(
        F.sqrt(F.avg(hold(F.col("d2")))).alias("hold"), F.sqrt(F.avg(train(F.col("e2")))).alias("train"), F.sqrt(F.avg("d2")).alias("error"),
        ratio(spread(hold(m)), spread(hold(y)), 0.05).alias("cv_hold"), ratio(spread(m), spread(y), 0.05).alias("cv"),
        ratio(F.stddev_pop(hold(F.col("hm"))), F.stddev_pop(hold(F.col("hy"))), 1e-6).alias("steps_hold"), ratio(F.stddev_pop("dm"), F.stddev_pop("dy"), 1e-6).alias("steps"),
        F.coalesce(correlation(y, m), F.lit(0.0)).alias("corr"), F.coalesce(F.avg(excess), largest, F.lit(0.0)).alias("spike"),
    )


def penalised(per: DataFrame) -> DataFrame:
    """(episode_id, spec_id, score), with fixed weights and limits: the upper quartile of the fold errors, plus penalties for fits that are too close,
    too flat or too jumpy, worse ahead than behind, or spiky."""
    names = ["train", "error", "cv_hold", "cv", "steps_hold", "steps", "corr", "spike"]
    m = per.groupBy("episode_id", "spec_id").agg(F.percentile("hold", 0.75).alias("score"), *[F.percentile(n, 0.5).alias(n) for n in names])
    over = lambda c, limit: F.greatest(c - limit, F.lit(0.0))
    flat, jump = F.least("cv_hold", "cv"), F.least("steps_hold", "steps")
    close = F.when((F.col("corr") > 0.97) & (F.col("error") < 0.12), 5 * (F.col("corr") - 0.97) + 4 * (0.12 - F.col("error"))).otherwise(0.0)
    score = F.col("score") + 5 * over(0.15 - F.col("train"), 0) + 6 * over(0.9 - flat, 0)
    score = score + F.when(jump < 0.7, 4 * (0.7 - jump)).otherwise(over(F.col("cv_hold"), 1.15)) + close
    m = m.withColumn("score", score)
    ahead = F.when((F.col("train") > 0) & (F.col("score") > 0), 0.8 * over(F.col("score") / (F.col("train") + 1e-8), 1.5)).otherwise(0.0)
    return m.select("episode_id", "spec_id", (F.col("score") + ahead + 3 * F.col("spike")).alias("score"))


def _scores(per: DataFrame, penalties: bool) -> DataFrame:
    return penalised(per) if penalties else per.groupBy("episode_id", "spec_id").agg(F.percentile("hold", 0.5).alias("score"))


def select_spec(rows: DataFrame, specs: DataFrame, fold_table: DataFrame, penalties: bool = False, keep: float | None = None) -> DataFrame:
    """The specification with the lowest score per episode: the median fold error of log1p, or with
    penalties the score of `penalised`.

    With `keep` the folds are rungs, the last one first: only that share of an episode's specifications, the best by the
    folds so far, is fitted on the next fold. What each rung found is written, so no fit is done twice.
    """
    victims = _victims(rows).select("episode_id", "hidden_unit")
    targets = fold_table.join(victims, "episode_id").withColumn("excluded_unit", F.lit(""))

    def tried(alive: DataFrame, at: DataFrame, warm: bool) -> DataFrame:
        return _fold_rows(fits(rows, _jobs(alive, at, "spec_id", "fold_id"), warm)).withColumn("spec_id", F.substring_index("job_id", "|", 1))

    each = Window.partitionBy("episode_id")
    order = each.orderBy(F.asc_nulls_last("score"), "spec_id")
    if keep is None:
        best = _scores(tried(specs, targets, False), penalties)
    else:
        specs = stage(specs, "specs")
        targets = stage(targets.withColumn("rung", F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("hide_from")))), "rungs")
        alive, per = specs, None
        for rung in range(1, (targets.agg(F.max("rung")).first()[0] or 0) + 1):
            new = stage(tried(alive, targets.filter(F.col("rung") == rung).drop("rung"), True), "rung")
            per = new if per is None else per.unionByName(new)
            # all of an episode's specifications stay after its last fold, and while none has a score
            reached = alive.select("episode_id", "spec_id").join(_scores(per, penalties), ["episode_id", "spec_id"], "left")
            ranked = reached.withColumns({"n": F.row_number().over(order), "of": F.count("*").over(each), "scored": F.count("score").over(each)})
            ranked = ranked.join(targets.groupBy("episode_id").agg(F.max("rung").alias("last")), "episode_id")
            stay = ranked.filter((F.col("n") <= F.ceil(F.col("of") * keep)) | (F.col("last") <= rung) | (F.col("scored") == 0)).select("episode_id", "spec_id")
            alive = stage(alive.join(stay, ["episode_id", "spec_id"], "left_semi"), "alive")
        if per is None:
            return specs.withColumn("score", F.lit(None).cast("double")).limit(0)
        best = _scores(per.join(alive.select("episode_id", "spec_id"), ["episode_id", "spec_id"], "left_semi"), penalties)
    best = best.filter("score IS NOT NULL").withColumn("n", F.row_number().over(order)).filter("n = 1").select("episode_id", "spec_id", "score")
    return specs.join(best, ["episode_id", "spec_id"])


def counterfactual(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """The victim's series without its POST periods, one job per episode and specification."""
    v = _victims(rows).select("episode_id", "hidden_unit", F.col("treat_start").alias("hide_from"), F.col("last_t").alias("hide_to"))
    return fits(rows, _jobs(specs, v.withColumn("excluded_unit", F.lit("")), "spec_id"))


def final_run(rows: DataFrame, specs: DataFrame, fold_table: DataFrame, embargo: int = 2, bags: int = 2, calibrate_last: int = 28, smooth_half: int = 0) -> DataFrame:
    """The victim's final series: the last PRE periods under embargo, the median of the fit and of `bags` more that
    each hide a fold, without growth of the penalties; level calibration, smoothing, nothing below 0."""
    v = _victims(rows).withColumn("excluded_unit", F.lit("")).withColumn("embargo", F.lit(embargo))
    none = v.select("episode_id", "hidden_unit", "excluded_unit", "embargo", F.lit("all").alias("bag"), F.col("treat_start").alias("gap_from"), F.col("treat_start").alias("hide_from"), F.col("last_t").alias("hide_to"))
    first = F.row_number().over(Window.partitionBy("episode_id").orderBy("hide_from"))
    bag = fold_table.withColumn("n", first).filter(F.col("n") <= bags).join(v, "episode_id")
    bag = bag.select("episode_id", "hidden_unit", "excluded_unit", "embargo", F.col("fold_id").alias("bag"), "gap_from", "hide_from", "hide_to")
    plain = specs.drop(*[c for c in ("growth", "cap") if c in specs.columns])
    out = fits(rows, _jobs(plain, none.unionByName(bag), "spec_id", "bag"))
    cf = as_series(out.groupBy("episode_id", "t", "treat_start").agg(F.first("y_obs").alias("y_obs"), F.percentile("mu0_hat", 0.5).alias("mu0_hat")))
    cf = level_calibration(cf, calibrate_last)
    cf = smooth(cf, smooth_half) if smooth_half else cf
    return cf.withColumn("mu0_hat", F.greatest("mu0_hat", F.lit(0.0)))


def placebo_space(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """The same with each control in the victim's place."""
    v = _victims(rows).select("episode_id", F.col("treat_start").alias("hide_from"), F.col("last_t").alias("hide_to"))
    controls = rows.filter("is_victim = 0").select("episode_id", F.col("unit_id").alias("hidden_unit")).distinct().join(v, "episode_id")
    return fits(rows, _jobs(specs, controls.withColumn("excluded_unit", F.lit("")), "spec_id", "hidden_unit"))


def placebo_time(rows: DataFrame, specs: DataFrame, least: int = 2, gap: int = 1) -> DataFrame:
    """The victim's last PRE periods hidden, as many as min(POST, max(least, PRE / 2)); short PRE windows have none."""
    n = rows.filter("is_victim = 1").groupBy("episode_id").agg(F.first("unit_id").alias("hidden_unit"), F.sum("is_pre").alias("pre"), F.sum(1 - F.col("is_pre")).alias("post"), F.max(F.when(F.col("is_pre") == 1, F.col("t"))).alias("last_pre"))
    n = n.withColumn("h", F.least("post", F.greatest(F.lit(least), F.floor(F.col("pre") / 2)))).filter(F.col("pre") > F.col("h") + gap)
    v = n.select("episode_id", "hidden_unit", (F.col("last_pre") - F.col("h") + 1).cast("int").alias("hide_from"), F.col("last_pre").alias("hide_to"), F.lit("").alias("excluded_unit"))
    return fits(rows, _jobs(specs, v, "spec_id"))


def leave_one_out(rows: DataFrame, specs: DataFrame) -> DataFrame:
    v = _victims(rows).select("episode_id", "hidden_unit", F.col("treat_start").alias("hide_from"), F.col("last_t").alias("hide_to"))
    out = rows.filter("is_victim = 0").select("episode_id", F.col("unit_id").alias("excluded_unit")).distinct().join(v, "episode_id")
    return fits(rows, _jobs(specs, out, "spec_id", "excluded_unit"))


def effects(fitted: DataFrame, hidden_only: bool = True) -> DataFrame:
    """(episode_id, job_id, att): mean of observed less fitted sales over the hidden periods."""
    df = fitted.filter("hidden = 1 AND y_obs IS NOT NULL") if hidden_only else fitted
    return df.groupBy(*JOB).agg(F.avg(F.col("y_obs") - F.col("mu0_hat")).alias("att"))


def prune_spiky(rows: DataFrame, times: float = 3.0, least: int = 8) -> DataFrame:
    """Rows without donors whose 95th percentile exceeds `times` the victim's, but with at least `least` donors,
    nearest in mean."""
    pre = rows.filter("is_pre = 1").groupBy("episode_id", "unit_id", "is_victim").agg(F.percentile("unit_sales", 0.95).alias("q"), F.avg("unit_sales").alias("m"))
    v = pre.filter("is_victim = 1").select("episode_id", F.col("q").alias("vq"), F.col("m").alias("vm"))
    d = pre.filter("is_victim = 0").join(v, "episode_id")
    w = Window.partitionBy("episode_id").orderBy((F.col("q") > times * F.col("vq")).cast("int"), F.abs(F.col("m") - F.col("vm")), "unit_id")
    good = d.withColumn("n", F.row_number().over(w)).filter((F.col("q") <= times * F.col("vq")) | (F.col("n") <= least))
    return rows.filter("is_victim = 1").unionByName(rows.filter("is_victim = 0").join(good.select("episode_id", "unit_id"), ["episode_id", "unit_id"], "left_semi"))


def as_series(fitted: DataFrame) -> DataFrame:
    return fitted.filter("y_obs IS NOT NULL").select("episode_id", F.lit("GSC").alias("model_type"), "t", "treat_start", "y_obs", "mu0_hat")
