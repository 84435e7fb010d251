"""Hand-sized cases with exact expected rows."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from promolens.functions import scalars as sc
from promolens.operators import donors, eda, exposure, features, metrics, pairs, quality, ranks, runs
from promolens.operators import episodes as ep
from promolens.plans import boosting, gsc, meta, placebo
from promolens.schema import Config, nan_to_null, require_columns
from promolens.sources import io
from promolens.streaming import events as ev
from promolens.streaming import incremental as inc

D = datetime.date


def panel(spark, rows):
    """rows: (day, store, item, class, sales, promo)"""
    df = spark.createDataFrame(rows, "t int, store_nbr int, item_nbr int, `class` int, unit_sales double, onpromotion int")
    return df.withColumn("date", F.date_add(F.lit(D(2020, 1, 1)), F.col("t")))


def series(spark, flags, sales=None):
    return panel(spark, [(t, 1, 1, 0, float((sales or [1] * len(flags))[k]), f) for k, (t, f) in enumerate(flags)])


def test_exposure_alone_and_of_three(spark):
    df = panel(spark, [(0, 1, 1, 0, 1.0, 1), (0, 1, 2, 0, 1.0, 0), (0, 1, 3, 0, 1.0, 1), (0, 2, 1, 0, 1.0, 1)])
    got = {(r.store_nbr, r.item_nbr): (r.H_prop_raw, r.H_disc, r.H_bin) for r in exposure.exposure(df).collect()}
    assert got == {(1, 1): (0.5, 1, 1), (1, 2): (1.0, 2, 1), (1, 3): (0.5, 1, 1), (2, 1): (None, 0, 0)}


def test_ema_with_a_hole(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0), (1, 1, 1, None), (1, 1, 2, 0.0)], "store_nbr int, item_nbr int, t int, x double")
    got = [r.y for r in exposure.ema(df, "x", "y", 0.5).orderBy("t").collect()]
    assert got[:2] == [1.0, 1.0] and math.isclose(got[2], 1 / 3)


def test_ema_leading_missing(spark):
    df = spark.createDataFrame([(1, 1, 0, None), (1, 1, 1, 2.0)], "store_nbr int, item_nbr int, t int, x double")
    assert [r.y for r in exposure.ema(df, "x", "y", 0.5).orderBy("t").collect()] == [None, 2.0]


def test_winsor_small_group_uses_global_bounds(spark):
    rows = [(1, float(i)) for i in range(29)] + [(2, float(i)) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "g int, x double")
    whole = [x for _, x in rows]
    got = exposure.winsorise(df, "x", "w", ["g"], 0.1, 0.9).filter("g = 1").agg(F.min("w"), F.max("w")).first()
    assert math.isclose(got[0], np.quantile(whole, 0.1)) and got[1] == 28.0


def test_collapse_duplicates(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1, 1, "0", 2.0, 1), (D(2020, 1, 1), 1, 1, "1", 3.0, 2)], "date date, store_nbr int, item_nbr int, onpromotion string, unit_sales double, k int")
    r = quality.collapse_sales(df, F.col("k"), ["k"]).first()
    assert (r.onpromotion, r.unit_sales, r.k) == (1, 5.0, 2)


def test_promo_spellings(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["sí", "T", " yes ", "0", None, "nan", "0.0"])], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(sc.promo_flag(F.col("x"))).collect()] == [1, 1, 1, 0, 0, 0, 1]


def test_run_over_a_missing_day(spark):
    got = [tuple(r) for r in runs.runs(series(spark, [(1, 1), (3, 1)])).select("run_start", "run_end", "n").collect()]
    assert got == [(1, 3, 2)]


@pytest.mark.parametrize(("gap", "expected"), [(0, [(1, 2), (4, 4)]), (1, [(1, 4)])])
def test_gap_runs(spark, gap, expected):
    df = series(spark, [(1, 1), (2, 1), (3, 0), (4, 1)])
    assert sorted((r.run_start, r.run_end) for r in runs.gap_runs(df, 1, gap).collect()) == expected


def test_episode_windows(spark):
    base = D(1970, 1, 1)
    start, end = ((d - base).days for d in (D(2016, 6, 1), D(2016, 6, 30)))
    w = runs.windows(F.lit(start), F.lit(end), Config())
    r = spark.range(1).select(*[F.date_from_unix_date(c).alias(n) for n, c in w.items()]).first()
    assert (r.pre_start, r.post_start, r.post_end) == (D(2016, 2, 25), D(2016, 6, 15), D(2016, 7, 14))


def test_donor_score(spark):
    r = spark.range(1).select(sc.donor_score(F.lit(0.25), F.lit(0.2), F.lit(0.1)), sc.donor_side(F.lit(0.25), F.lit(0.2))).first()
    assert math.isclose(r[0], 0.14875) and r[1] == "above"


def test_intermittency_and_streaks(spark):
    df = series(spark, [(t, 0) for t in range(5)], [0, 5, 0, 0, 3])
    assert features.intermittency(df).first().ADI == 1.0
    df = series(spark, [(t, 0) for t in range(4)], [0, 0, 4, 0])
    assert [r.zero_streak for r in runs.zero_streaks(df).orderBy("t").collect()] == [1, 2, 0, 1]


def test_rolling_starts_anew_for_each_unit(spark):
    df = panel(spark, [(t, 1, i, 0, 1.0 + t, 0) for i in (1, 2) for t in range(3)])
    first = features.sales_history(df, (1,), (7,)).filter("t = 0").collect()
    assert all(r.roll_mean_7 is None and r.unit_sales_l1 is None for r in first)


def test_regional_share(spark):
    stores = spark.createDataFrame([(1, "s"), (2, "s")], "store_nbr int, state string")
    tx = spark.createDataFrame([(D(2020, 1, 6), 1, 30), (D(2020, 1, 7), 2, 70)], "date date, store_nbr int, transactions int")
    assert {r.store_nbr: r.R_share for r in features.regional_share(tx, stores).collect()} == {1: 0.3, 2: 0.7}


def test_holiday_hierarchy(spark):
    h = spark.createDataFrame([("2020-01-01", "Holiday", "National", "X"), ("2020-01-02", "Holiday", "Regional", "s"), ("2020-01-03", "Holiday", "Local", "c"), ("2020-01-04", "Transfer", "National", "X")], "date string, type string, locale string, locale_name string")
    h = h.withColumn("date", F.to_date("date")).withColumn("transferred", F.lit(False))
    stores = spark.createDataFrame([(1, "s", "c"), (2, "s", "other")], "store_nbr int, state string, city string")
    df = panel(spark, [(t, s, 1, 0, 1.0, 0) for t in range(4) for s in (1, 2)])
    got = {(r.store_nbr, r.t): (r.HNat, r.HReg, r.HLoc) for r in features.attach_holidays(df, h, stores).collect()}
    assert got[(1, 0)] == (1, 0, 0) and got[(1, 1)] == (0, 1, 0) and got[(1, 2)] == (0, 0, 1) and got[(2, 2)] == (0, 0, 0) and got[(1, 3)] == (0, 0, 0)


def test_rmspe_floor(spark):
    cf = spark.createDataFrame([("e", "m", t, 2, 0.1, 0.0) for t in (0, 1)], "episode_id string, model_type string, t int, treat_start int, y_obs double, mu0_hat double")
    assert math.isclose(metrics.fit(cf).first().rmspe_pre, 0.1) and math.isclose(metrics.fit(cf, 1e-8).first().rmspe_pre, 1.0)


def test_placebo_p(spark):
    att = spark.createDataFrame([("e", "m", 5.0)], "episode_id string, model_type string, att_mean double")
    draws = spark.createDataFrame([("e", "m", x) for x in (1.0, -6.0, 2.0)], "episode_id string, model_type string, att double")
    assert metrics.placebo(draws, att).first().p_value == 0.5


def test_time_folds(spark):
    df = panel(spark, [(t, 1, 1, 0, 1.0, 0) for t in range(100)])
    got = meta.time_folds(df, 21, 3).groupBy("fold").agg(F.min("t").alias("s")).orderBy("fold").collect()
    assert [r.s for r in got] == [37, 58, 79]


def episode_rows(spark, drop=0.0, donors_n=5, periods=40, start=30):
    rows = []
    for u in range(donors_n + 1):
        for t in range(periods):
            y = (10 + 3 * math.sin(t / 3)) * (1 + 0.1 * u)
            rows.append((t, 1 + u, 1, 0, y - (drop if u == 0 and t >= start else 0.0), 0))
    units = spark.createDataFrame([(u + 1, int(u == 0)) for u in range(donors_n + 1)], "store_nbr int, is_victim int")
    df = panel(spark, rows).join(units, "store_nbr").withColumn("episode_id", F.lit("e")).withColumn("treat_start", F.lit(start))
    return df.withColumn("is_pre", (F.col("t") < start).cast("int")).withColumn("unit_id", F.concat_ws(":", "store_nbr", "item_nbr"))


def test_low_rank_recovery():
    y = np.outer(np.arange(1, 7), 5 + np.sin(np.arange(40)))
    mask = np.ones_like(y, bool)
    mask[0, 30:] = False
    fitted = gsc.complete(np.where(mask, y, 0), mask, None, 2, 0.001, 0.01)
    assert np.abs(fitted[0, 30:] / y[0, 30:] - 1).max() < 0.05


def test_planted_effect_is_found(spark):
    rows = episode_rows(spark, drop=2.0)
    blend = ep.donor_blend(rows).withColumn("model_type", F.lit("B"))
    assert abs(metrics.att(blend).first().att_mean + 2) < 0.2
    specs = gsc.grid(rows, (2,), (0.001,)).withColumn("covariates", F.lit(False))
    cf = gsc.as_series(gsc.counterfactual(rows, specs))
    assert abs(metrics.att(cf).first().att_mean + 2) < 0.5
    stack = meta.sample_weights(meta.treatment(rows.withColumn("D", F.col("is_victim") * (1 - F.col("is_pre"))).withColumn("y", F.col("unit_sales")), "D"))
    stack = stack.withColumn("f", F.sin(F.col("t") / 3)).withColumn("level", (1 + 0.1 * (F.col("store_nbr") - 1)).cast("double"))
    spec = meta.Learner(["f", "level"], params={"regParam": 0.0001})
    out = meta.series(meta.cross_fit(stack, "S", spec, meta.time_folds(stack, 5, 1)), "S", calibrate=False)
    assert metrics.att(out).first().att_mean < -1


def test_donor_blend_equals_numpy(spark):
    rows = episode_rows(spark, drop=1.0, donors_n=3)
    wide = rows.toPandas().pivot_table(index="t", columns="unit_id", values="unit_sales")
    x, y = wide[["2:1", "3:1", "4:1"]].to_numpy(), wide["1:1"].to_numpy()
    w = np.linalg.solve(x[:30].T @ x[:30] + np.eye(3), x[:30].T @ y[:30])
    got = [r.mu0_hat for r in ep.donor_blend(rows).orderBy("t").collect()]
    assert np.allclose(got, x @ w)


def test_placebo_fan_out_covers_each_control(spark):
    rows = episode_rows(spark)
    specs = gsc.grid(rows, (1,), (0.01,))
    assert gsc.effects(gsc.placebo_space(rows, specs)).count() == 5
    assert gsc.effects(gsc.leave_one_out(rows, specs)).count() == 5
    assert gsc.effects(gsc.placebo_time(rows, specs)).count() == 1


def test_assignment_test_bounds(spark):
    r = placebo.assignment_test(episode_rows(spark, drop=5.0), 20).first()
    assert 0 < r.p_value <= 1 and r.att < 0


def test_required_columns_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(df).filter("x IS NULL").count() == 1
    with pytest.raises(ValueError, match="y"):
        require_columns(df, ["x", "y"])


def test_strict_dates_raise(spark):
    df = spark.createDataFrame([("2020-01-01",), ("oops",)], "date string")
    with pytest.raises(Exception, match="not a date"):
        quality.strict_dates(df).collect()


def test_round_trip_of_csv_and_partitions(spark, tmp_path):
    df = panel(spark, [(0, 1, 1, 0, 1.5, 1), (0, 2, 1, 0, 2.0, 0)]).select("date", "store_nbr", "item_nbr", "unit_sales", F.col("onpromotion").cast("string"))
    io.write_table(df, f"{tmp_path}/p.csv")
    assert sorted((r.store_nbr, r.onpromotion) for r in io.read_panel(spark, f"{tmp_path}/p.csv").collect()) == [(1, 1), (2, 0)]
    with pytest.raises(ValueError):
        io.read_under(spark, str(tmp_path), "../x.parquet")


def test_no_self_donors_and_top_k(spark):
    stats = spark.createDataFrame([("e", 1, 1, s, 1, "same_item", 0.01 * s, 1.0, 1.0) for s in range(2, 20)], "episode_id string, j_store int, j_item int, store_nbr int, item_nbr int, donor_kind string, distance double, score double, x double")
    ranked = donors.rank_per_victim(stats, 10)
    assert ranked.count() == 10 and ranked.agg(F.max("rank")).first()[0] == 10 and donors.self_donors(ranked).first().n_self == 0


@pytest.fixture(scope="module")
def tied_donors(spark):
    """Two episodes of victim (0, 1) and one of (3, 1), and their donors. Stores 0 to 30 sell item 1 alike; 1 to 30 have the same shares, each in an order of its own, store 0 some of them."""
    rng = np.random.default_rng(5)
    shares = np.repeat([0.0, 0.25, 1 / 3, 0.5, 2 / 3, 1.0], [30, 20, 7, 5, 5, 3])
    units = [(0, 1, *[float(x) for x in rng.permutation(shares)][:60]), *[(s, 1, *[float(x) for x in rng.permutation(shares)]) for s in range(1, 31)]]
    seen = spark.createDataFrame([(s, i, 0, t, x) for s, i, *xs in units for t, x in enumerate(xs)], "store_nbr int, item_nbr int, `class` int, t int, H_prop_raw double")
    eps = spark.createDataFrame([("e1", 0, 2, 0, 1, 0, 11, 0), ("e2", 0, 3, 0, 1, 0, 11, 0), ("e3", 3, 2, 3, 1, 0, 11, 0)], "episode_id string, i_store int, i_item int, j_store int, j_item int, pre_start int, pre_end int, `class` int")
    attributes = [F.lit(x).alias(x) for x in ("type", "city", "state")]
    prof = donors.profiles(pairs.exposure_profile(seen), spark.createDataFrame([(1, 0)], "item_nbr int, `class` int"), seen.select("store_nbr").distinct().select("store_nbr", *attributes))
    sales = seen.filter("t < 12").select("store_nbr", "item_nbr", "t", (F.col("t") % 4 + 5.0).alias("unit_sales"))
    ranked = donors.rank_per_victim(donors.choose(donors.with_stats(donors.candidates(eps, prof, 20), eps, sales), Config.monthly()), 10)
    return eps, spark.createDataFrame(ranked.collect(), ranked.schema)


def test_never_treated_donors_of_equal_profiles_go_by_store(tied_donors):
    eps, ranked = tied_donors
    got = donors.never_treated(donors.per_episode(ranked, eps), eps).filter("episode_id = 'e1'").orderBy("rank").collect()
    assert [(r.store_nbr, r["rank"]) for r in got] == [(s, s) for s in range(1, 11) if s != 3]


def test_each_episode_of_a_victim_has_its_equal_donors_by_store(tied_donors):
    eps, ranked = tied_donors
    got = {(r.episode_id, r.store_nbr, r["rank"]) for r in donors.per_episode(ranked, eps).collect()}
    of_e3 = [s for s in range(1, 12) if s != 3]  # store 0 has other shares
    assert got == {(e, s, s) for e in ("e1", "e2") for s in range(1, 11)} | {("e3", s, n + 1) for n, s in enumerate(of_e3)}


def test_donor_ranks_of_equal_profiles_go_by_store(tied_donors):
    ranked = tied_donors[1].filter("j_store = 0").collect()
    assert sorted((r["rank"], r.store_nbr, r.item_nbr, r.donor_kind) for r in ranked) == [(s, s, 1, "same_item") for s in range(1, 11)]
    assert len({r.distance for r in ranked}) == 1


def test_equal_distances_are_ties_on_either_side_of_the_victim(spark):
    """Stores 1 to 9 are 0.1 off the victim's mean or 0.1 * sqrt(2.5) off its deviation, up or down by turns, store 10 is nearer."""
    v, off, sds = 0.3, 0.1, 0.1 * math.sqrt(2.5)
    near = [(v + off, 0.2, 0.5), (v - off, 0.2, 0.5), (v, 0.2 + sds, 0.5), (v, 0.2 - sds, 0.5)]
    rows = [(0, 1, v, 0.2, 0.5), (10, 1, v, 0.2, 0.51), (10, 2, v, 0.2, 0.51), *[(s, i, *near[(s + i) % 4]) for s in range(1, 10) for i in (1, 2)]]
    prof = spark.createDataFrame([(s, i, 0, *p, "A", "B", "C") for s, i, *p in rows], "store_nbr int, item_nbr int, `class` int, h_mean double, h_sd double, p_any double, type string, city string, state string")
    eps = spark.createDataFrame([("e", 0, 2, 0, 1, 0, 5, 0)], "episode_id string, i_store int, i_item int, j_store int, j_item int, pre_start int, pre_end int, `class` int")
    got = donors.candidates(eps, prof, 4).collect()
    assert sorted((r.donor_kind, r.store_nbr) for r in got) == [(kind, s) for kind in ("same_class", "same_item") for s in (1, 2, 3, 10)]


def test_transitions_complete(spark):
    got = {(r.prev, r.curr): r.n for r in eda.promo_transitions(series(spark, [(0, 0), (1, 1), (2, 1)])).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1}


def test_empty_panel(spark):
    df = series(spark, [(0, 1)]).limit(0)
    assert exposure.exposure(df).count() == 0 and runs.runs(df).count() == 0 and pairs.promo_profile(df).count() == 0


def test_store_folders_split_hot_stores_and_keep_others(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") < 58_000, 1).otherwise(F.col("id") % 3 + 2).cast("int").alias("store_nbr"), F.sha2(F.col("id").cast("string"), 256).alias("x"), F.col("id").alias("t"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        io.write_by_store(rows, f"{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = list((tmp_path / "s" / "store_nbr=1").glob("*.parquet"))
    assert len(hot) > 2
    io.write_by_store(rows.filter("store_nbr = 3").withColumn("t", F.lit(-1).cast("long")), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 60_000 and back.filter("t = -1").select("store_nbr").distinct().collect() == [(3,)]
    assert sorted(hot) == sorted((tmp_path / "s" / "store_nbr=1").glob("*.parquet"))


def test_packed_fits_equal_fits_of_the_bare_matrix(spark):
    rows = episode_rows(spark, drop=2.0)
    jobs = gsc.grid(rows, (1, 2), (0.05, 0.2)).withColumn("job_id", F.col("spec_id"))
    v = rows.filter("is_victim = 1").groupBy("episode_id").agg(F.first("unit_id").alias("hidden_unit"), F.min("treat_start").alias("hide_from"), F.max("t").alias("hide_to"))
    jobs = jobs.join(v, "episode_id").withColumn("excluded_unit", F.lit(""))
    got = {(r.job_id, r.t): r.mu0_hat for r in gsc.fits(rows, jobs, slots=3).collect()}
    wide = rows.toPandas().pivot_table(index="unit_id", columns="t", values="unit_sales", aggfunc="sum").sort_index()
    y, times, units = wide.to_numpy(float), wide.columns.to_numpy(), wide.index.to_numpy()
    for job in jobs.toPandas().assign(victim=lambda d: d["hidden_unit"], treat_start=lambda d: d["hide_from"]).to_dict("records"):
        seen = gsc.train_mask(~np.isnan(y), units, times, pd.Series(job))
        year = 2 * np.pi * times / 12.0
        x = np.stack([np.broadcast_to(c, y.shape) for c in (np.sin(year), np.cos(year), (times - times.mean()) / times.std())], axis=2)
        want = gsc.complete(np.nan_to_num(y), seen, x, job["rank"], job["tau"], job["alpha"])[units == job["hidden_unit"]][0]
        assert np.allclose([got[job["job_id"], t] for t in times], want, rtol=1e-9)


def test_warm_path_settles_where_cold_fits_do():
    rng = np.random.default_rng(3)
    y = np.exp(rng.normal(size=(8, 2)) @ rng.normal(size=(2, 30)) * 0.4 + 1) + rng.random((8, 30))
    mask = rng.random((8, 30)) < 0.9
    start = None
    for tau in (6.0, 3.0, 1.5):
        ends = []
        warm = gsc.complete(y, mask, None, 8, tau, 0.01, inner=20_000, tol=1e-12, start=start, ends=ends)
        assert np.allclose(warm, gsc.complete(y, mask, None, 8, tau, 0.01, inner=20_000, tol=1e-12), atol=1e-6)
        start = tuple(ends)


def test_soft_impute_equals_singular_values():
    rng = np.random.default_rng(4)
    for shape in ((5, 20), (20, 5)):
        y, mask, low = rng.normal(size=shape), rng.random(shape) < 0.8, np.zeros(shape)
        for _ in range(9):
            u, s, v = np.linalg.svd(np.where(mask, y, low), full_matrices=False)
            low = (u[:, :3] * np.maximum(s[:3] - 0.7, 0)) @ v[:3]
        assert np.allclose(gsc.soft_impute(y, mask, 0.7, 3, 9, 0.0), low, atol=1e-10)


def test_specifications_by_rungs(spark):
    rows = episode_rows(spark, drop=2.0)
    specs, folds = gsc.grid(rows, (1, 2), (0.001, 0.2, 5.0)), gsc.folds(rows)
    one = gsc.select_spec(rows, specs, folds, keep=0.01).collect()  # one is left after the last fold
    last = folds.orderBy(F.desc("hide_from")).limit(1)
    assert [(r.episode_id, r.spec_id) for r in one] == [(r.episode_id, r.spec_id) for r in gsc.select_spec(rows, specs, last).collect()]
    every = gsc.select_spec(rows, specs, folds, keep=1.0).collect()
    assert len(every) == 1 and every[0].score < 1
    assert gsc.select_spec(rows, specs, folds.limit(0), keep=0.5).count() == 0


def poisson_trees(x, y, w, edges, p):
    """The same model by loops over arrays; returns the fitted means."""
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), math.log((w * y).sum() / w.sum()))
    for _ in range(p.trees):
        m = w * np.exp(score)
        g, h = np.round((m - w * y) * 2**20) / 2**20, np.round(m * 2**20) / 2**20
        step = np.zeros(len(y))

        def grow(rows, depth, g=g, h=h, step=step):
            best = (p.gain, None)
            for j in range(x.shape[1]) if depth else ():
                for b in range(len(edges[j])):
                    left = rows & (bins[:, j] <= b)
                    right = rows & ~left
                    if min(left.sum(), right.sum()) >= p.least:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + p.l2) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + p.l2)
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
            if best[1]:
                for side in best[1]:
                    grow(side, depth - 1)
            else:
                step[rows] = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)

        grow(np.full(len(y), True), p.depth)
        score += step
    return np.exp(score)


def test_poisson_boosting_equals_numpy_however_rows_are_dealt(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 3)
    x[:, 2] = rng.integers(0, 3, 300)
    y = rng.poisson(np.exp(0.8 * (x[:, 0] > 0.3) + 0.5 * (x[:, 2] == 1)))
    w = rng.integers(1, 4, 300).astype(float)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), float(w[i])) for i in range(300)], "i int, a double, b double, c double, y int, w double")
    p = boosting.Params(trees=11, depth=2, bins=8, rate=0.2)
    models = [boosting.fit(df.repartition(n), ["a", "b", "c"], "y", "w", p) for n in (1, 7)]
    assert models[0] == models[1]
    edges = [boosting.bin_edges(df, [c], 8)[c] for c in "abc"]
    assert all(1 <= len(e) <= 7 for e in edges)
    got = np.array([r["p"] for r in models[0].predict(df, "p").orderBy("i").collect()])
    assert np.allclose(got, poisson_trees(x, y, w, edges, p), rtol=1e-9)
    assert np.corrcoef(got, np.exp(0.8 * (x[:, 0] > 0.3) + 0.5 * (x[:, 2] == 1)))[0, 1] > 0.8


def test_poisson_boosting_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 2), (1.0, None), (3.0, 4)], "a double, y int")
    model = boosting.fit(df.filter("y IS NOT NULL"), ["a"], "y")
    assert [round(r["p"], 6) for r in model.predict(df, "p").collect()] == [3.0] * 3
    assert boosting.fit(df.filter("false"), ["a"], "y").predict(df, "p").first()["p"] < 1e-5


def test_rungs_find_what_the_whole_search_finds(spark):
    rng = random.Random(2)
    rows = [(f"e{u}", 1, u, t, int(t % 3 == 0), float(3 * t + u + rng.random()), float(t), 1.0) for u in range(4) for t in range(30)]
    df = spark.createDataFrame(rows, "episode_id string, store_nbr int, item_nbr int, t int, D_bin int, y double, x double, w double").withColumn("D_cont", F.col("D_bin").cast("double"))
    folds, spec = meta.time_folds(df, 4, 3), meta.Learner(["x"])
    sets = [{"regParam": r} for r in (50.0, 1e-3, 5.0, 500.0)]
    whole, rungs = meta.tune(df, "S", spec, folds, sets), meta.tune(df, "S", spec, folds, sets, keep=0.5)
    assert whole[0] == {"regParam": 1e-3} and rungs[0] == whole[0] and abs(whole[1] - rungs[1]) < 1e-12


def random_panel(spark, seed=8, months=10):
    rng = random.Random(seed)
    rows = [(D(2020, 1 + m, 1), m, s, i, i % 3, float(rng.randint(0, 9)), int(rng.random() < 0.4)) for m in range(months) for s in range(3) for i in range(7) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "date date, t int, store_nbr int, item_nbr int, `class` int, unit_sales double, onpromotion int")


def compared(df, names):
    return sorted(df.select(*[F.round(c, 9).alias(c) if df.schema[c].dataType.typeName() == "double" else c for c in names]).collect(), key=str)


def test_incremental_exposure_survives_replays_late_rows_and_merging(spark, tmp_path):
    panel, feed, path = random_panel(spark), f"{tmp_path}/in", f"{tmp_path}/out"
    names = ["date", "store_nbr", "item_nbr", "H_disc", "H_prop_raw", "H_bin"]
    late = F.col("item_nbr") == 2  # comes a part later than it should
    steps = [(F.col("t") < 4) & ~late, ((F.col("t") < 7) & ~late) | ((F.col("t") < 4) & late), ((F.col("t") >= 7) & ~late) | ((F.col("t") >= 4) & late)]
    for k, wanted in enumerate(steps):
        panel.filter(wanted).write.mode("append").parquet(feed)
        if k == 2:
            panel.filter("t = 9 AND NOT item_nbr = 2").write.mode("append").parquet(feed)  # the same rows once more
        query = inc.stream_exposure(spark.readStream.schema(panel.schema).parquet(feed), path, late="300 days")
        query.awaitTermination()
        if k == 1:
            first = spark.read.schema(panel.schema).parquet(f"{path}/rows/epoch=0")
            inc.write_epoch(spark.createDataFrame(first.collect(), panel.schema), 0, path)  # epoch 0 is replayed
            inc.merge_epochs(spark, path, 0)
            inc.merge_epochs(spark, path, 0)
    want = exposure.exposure(panel)
    assert compared(inc.current_exposure(spark, path), names) == compared(want, names)
    for by, of in (("date", exposure.by_date), ("store_nbr", exposure.by_store)):
        got = inc.exposure_totals(inc.totals(spark, path), by)
        assert compared(got, of(want).columns) == compared(of(want), of(want).columns)


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    panel, feed, path = random_panel(spark), f"{tmp_path}/in", f"{tmp_path}/out"
    for wanted in ("t = 8", "t = 9", "t = 0"):
        panel.filter(wanted).write.mode("append").parquet(feed)
        inc.stream_exposure(spark.readStream.schema(panel.schema).parquet(feed), path, late="1 day").awaitTermination()
    assert {r["date"].month for r in inc.totals(spark, path).select("date").distinct().collect()} == {9, 10}


@pytest.mark.parametrize(("min_run", "max_gap"), [(1, 0), (3, 2)])
def test_gap_run_stream_equals_table(spark, tmp_path, min_run, max_gap):
    rng = random.Random(9)
    rows = [(u, 1, t, int(rng.random() < 0.4)) for u in range(4) for t in range(40)]
    df = spark.createDataFrame([*rows, (9, 9, 5, 1), (9, 9, 5, 1)], "store_nbr int, item_nbr int, t int, onpromotion int")
    inc.rocksdb_state(spark)
    # each part holds rows up to four periods too late
    late = (F.col("t") - F.when(F.col("t") % 3 == 0, 0).otherwise(4)).alias("at")
    marked = df.select("*", late)
    for k in range(3):
        part = marked.filter(F.col("at").between(-4 + k * 15, 10 + k * 15)).drop("at")
        part = part.unionByName(spark.createDataFrame([(-1, -1, 1000, 0)], df.schema)) if k == 2 else part
        part.write.mode("append").parquet(f"{tmp_path}/in")
        found = inc.stream_gap_runs(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), min_run, max_gap, late="9 days")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, runs.gap_runs(df.distinct(), min_run, max_gap).collect()))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # no state is left


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2020, 1, 1, h), h % 3, "a", 1.0) for h in range(24)], "ts timestamp, user_id int, event_type string, value double")
    df.write.parquet(f"{tmp_path}/e")
    q = ev.windowed_totals(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e"), "6 hours").writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from totals").collect()} == {tuple(r) for r in ev.windowed_totals(df, "6 hours").collect()}


def test_quantiles_and_buckets_of_any_group(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 400), rng.integers(0, 40, 400), strict=True)] + [(0, None), (7, None), (8, 5.0)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = {r.g: (r.n, r.a, r.b) for r in ranks.quantiles(df, "x", {"a": 0.05, "b": 0.5}, ["g"]).collect()}
    for g in (0, 1, 2, 8):
        own = [x for h, x in rows if h == g and x is not None]
        assert got[g][0] == len(own) and np.allclose(got[g][1:], np.quantile(own, [0.05, 0.5]))
    assert set(got) == {0, 1, 2, 8}
    assert np.isclose(ranks.quantiles(df, "x", {"q": 0.9}).first().q, np.quantile([x for _, x in rows if x is not None], 0.9))
    assert ranks.quantiles(df.limit(0), "x", {"q": 0.9}, ["g"]).count() == 0
    units = spark.createDataFrame([(i, (i * 7) % 23) for i in range(23)], "store_nbr int, v int")
    buckets = ranks.buckets(units, ["v", "store_nbr"], 5, "b").orderBy("v").collect()
    assert [r.b for r in buckets] == [1] * 5 + [2] * 5 + [3] * 5 + [4] * 4 + [5] * 4
    assert sorted(r.b for r in ranks.buckets(units.limit(3), ["v"], 5, "b").collect()) == [1, 2, 3]


def test_ema_of_a_long_series_equals_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    x = [None if rng.random() < 0.2 else float(rng.random()) for _ in range(300)]
    df = spark.createDataFrame([(1, 1, t, v) for t, v in enumerate(x)], "store_nbr int, item_nbr int, t int, x double")
    got = [r.y for r in exposure.ema(df, "x", "y", 0.25).orderBy("t").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=0.25, adjust=False, ignore_na=False).mean()
    assert np.allclose(np.array(got, float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("piece", [1, 3, 50, 4096])
def test_ema_over_pieces_equals_pandas(spark, piece):
    rng = np.random.default_rng(piece)
    series = {
        1: [None if rng.random() < 0.4 else float(rng.random()) for _ in range(400)],
        2: [None] * 30 + [1.0] + [None] * 20 + [3.0],
        3: [None] * 5,
        4: [2.0],
        None: [float(i % 7) for i in range(60)],
    }
    rows = [(u, t, x, f"r{t}") for u, xs in series.items() for t, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if u is None else int(u), int(t), None if x is None else float(x), r) for u, t, x, r in rows], "u int, t int, x double, note string")
    found = exposure.ema_of_long_series(df, "x", "y", 0.3, unit=["u"], piece=piece)
    assert found.columns == ["u", "t", "x", "note", "y"]
    got = {(r.u, r.t): r for r in found.collect()}
    assert len(got) == len(rows) and all(r.note == f"r{t}" for (_, t), r in got.items())
    for u, xs in series.items():
        want = pd.Series(xs, dtype=float).ewm(alpha=0.3, adjust=False, ignore_na=False).mean()
        assert np.allclose(np.array([got[u, t].y for t in range(len(xs))], float), want.to_numpy(), equal_nan=True)
    whole = {(r.u, r.t): r.y for r in exposure.ema(df, "x", "y", 0.3, unit=["u"]).collect()}
    assert all(got[k].y is None if y is None else math.isclose(got[k].y, y, rel_tol=1e-12) for k, y in whole.items())
    assert exposure.ema_of_long_series(df.limit(0), "x", "y", 0.3, unit=["u"]).count() == 0


def test_one_long_series_is_spread(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("u"), F.col("id").alias("t"), F.when(F.col("id") % 5 > 0, F.sin(F.col("id").cast("double"))).alias("x"))
    got = exposure.ema_of_long_series(df, "x", "y", 0.01, unit=["u"]).withColumn("task", F.spark_partition_id()).cache()
    pdf = got.toPandas().sort_values("t")
    want = pdf["x"].ewm(alpha=0.01, adjust=False, ignore_na=False).mean()
    assert np.allclose(pdf["y"], want, equal_nan=True) and pdf["task"].nunique() > 1
    got.unpersist()


def holed_panel(spark, seed=9, items=7, periods=40):
    """A neighbourhood of units with holes in their calendars and runs of several lengths."""
    rng = np.random.default_rng(seed)
    rows = []
    for item in range(items):
        on = 0
        for t in range(periods):
            on = int(rng.random() < (0.7 if on else 0.25))
            if rng.random() < 0.85:
                rows.append((t, 1 + (item == 6), item, 0, 1.0, on))
    return panel(spark, rows)


def brute_runs(spark, found):
    out = {}
    for r in found.collect():
        out.setdefault((r.store_nbr, r.item_nbr), []).append((r.run_start, r.run_end))
    return out


@pytest.mark.parametrize("min_run", [1, 3])
def test_run_contrasts_equal_brute_force(spark, min_run):
    exposed = exposure.exposure(holed_panel(spark)).select("store_nbr", "item_nbr", "class", "t", "H_prop_raw").cache()
    found = runs.runs(holed_panel(spark), min_run)
    spans = brute_runs(spark, found)
    rows = [tuple(r) for r in exposed.collect()]
    units = exposed.select("store_nbr", "item_nbr", "class").distinct()
    inside = lambda u, t: any(a <= t <= b for a, b in spans.get(u, []))
    for exact in (True, False):
        want = {}
        for u in {r[:2] for r in rows}:
            means = {True: [], False: []}
            for t in sorted({r[3] for r in rows if r[0] == u[0]}):
                xs = [x for s, i, _, d, x in rows if s == u[0] and d == t and x is not None and not (exact and i == u[1])]
                if xs:
                    means[inside(u, t)].append(np.mean(xs))
            if means[True] and means[False]:
                want[u] = (len(means[True]), len(means[False]), np.mean(means[True]) - np.mean(means[False]))
        got = {(r.store_nbr, r.item_nbr): (r.n_on, r.n_off, r.delta_H_cls) for r in pairs.score_cannibals(units, exposed, found, exact).collect()}
        assert got.keys() == want.keys() and got
        assert all(got[u][:2] == want[u][:2] and math.isclose(got[u][2], want[u][2], abs_tol=1e-9) for u in got)
    for overlap in (True, False):
        want = {}
        for i in {r[:2] for r in rows}:
            for j in {r[:2] for r in rows if r[0] == i[0] and r[1] != i[1]}:
                own = [(t, x) for s, k, _, t, x in rows if (s, k) == j and (overlap or not inside(j, t))]
                on, off = ([x for t, x in own if x is not None and inside(i, t) == side] for side in (True, False))
                if own:
                    want[i[0], i[1], j[1]] = (len(on), len(off), np.mean(on) - np.mean(off) if on and off else None)
        got = {(r.store_nbr, r.i_item, r.j_item): (r.n_obs_i_on, r.n_obs_i_off, r.delta_H_j) for r in pairs.score_victims(units, units, exposed, found, overlap).collect()}
        assert got.keys() == want.keys() and got
        for k, (n, m, d) in got.items():
            assert (n, m) == want[k][:2] and (d is None) == (want[k][2] is None) and (d is None or math.isclose(d, want[k][2], abs_tol=1e-9))


def test_nearest_profiles_equal_brute_force_and_read_part_of_the_class(spark):
    rng = np.random.default_rng(2)
    prof = {(s, i): tuple(np.round(rng.random(3) * (1, 0.5, 1), 2)) for s in range(40) for i in range(100)}
    prof[3, 7] = (None, 0.0, 0.0)  # no profile
    prof |= {(s, 1): prof[0, 1] for s in range(20)}  # ties
    at = lambda u: [None if x is None else float(x) for x in prof[u]]
    table = spark.createDataFrame([(s, i, 0, *at((s, i)), "A", "B", "C") for s, i in prof], "store_nbr int, item_nbr int, `class` int, h_mean double, h_sd double, p_any double, type string, city string, state string")
    victims = [(0, 1), (0, 50), (5, 99), (3, 7), (39, 0)]
    ep_rows = [(f"e{n}", s, (i + 1) % 100, s, i, 0, 5, 0) for n, (s, i) in enumerate(victims)]
    eps = spark.createDataFrame(ep_rows, "episode_id string, i_store int, i_item int, j_store int, j_item int, pre_start int, pre_end int, `class` int")
    got = {}
    for r in donors.candidates(eps, table, 10).collect():
        got.setdefault((r.episode_id, r.donor_kind), set()).add((r.store_nbr, r.item_nbr))
    for n, v in enumerate(victims):
        def far(u, v=v):
            if None in prof[u] or None in prof[v]:
                return math.inf
            a, b, c = (y - x for x, y in zip(prof[v], prof[u], strict=True))
            return round(math.sqrt(0.5 * a * a + 0.2 * b * b + 0.3 * c * c), 12)

        for kind, of in (("same_item", [u for u in prof if u[1] == v[1] and u[0] != v[0]]), ("same_class", [u for u in prof if u[1] != v[1] and u[0] != v[0]])):
            assert [far(u) for u in sorted(got[f"e{n}", kind], key=lambda u: (far(u), u))] == [far(u) for u in sorted(of, key=lambda u: (far(u), u))[:10]]
    grid = donors._grid(table.withColumnRenamed("class", "d_class"), donors.GRID_BITS[-1])
    asked = table.filter("store_nbr = 0 AND item_nbr = 50").select(F.lit("e").alias("episode_id"), "class", F.lit(50).alias("need"), *[F.col(c).alias(f"v_{c}") for c in donors.PROFILE])
    assert 50 <= donors.near_cells(asked, grid).join(grid, ["d_class", "c0", "c1", "c2"]).count() < 400  # of 4,000


def test_train_mask_hides_gap_fold_post_and_embargo():
    import pandas as pd

    mask, units, periods = np.full((2, 10), True), np.array(["a", "v"]), np.arange(10)
    job = pd.Series({"hidden_unit": "v", "victim": "v", "hide_from": 3, "hide_to": 4, "gap_from": 2, "treat_start": 8, "embargo": 1})
    assert np.flatnonzero(~gsc.train_mask(mask, units, periods, job)[1]).tolist() == [2, 3, 4, 7, 8, 9] and gsc.train_mask(mask, units, periods, job)[0].all()
    assert np.flatnonzero(~gsc.train_mask(mask, units, periods, pd.Series({**job, "all_rows": True}))[0]).tolist() == [2, 3, 4]


def test_search_penalties(spark):
    row = {"episode_id": "e", "spec_id": "s", "hold": 0.2, "train": 0.3, "error": 0.2, "cv_hold": 1.0, "cv": 1.0, "steps_hold": 1.0, "steps": 1.0, "corr": 0.5, "spike": 0.0}
    cases = {  # each breaks one rule: (changes, score)
        "plain": ({}, 0.2), "close": ({"train": 0.14}, 0.25 + 0.8 * (0.25 / 0.14 - 1.5)), "flat": ({"cv": 0.5}, 0.2 + 6 * 0.4 + 0.8 * (2.6 / 0.3 - 1.5)), "jumpy": ({"cv_hold": 1.25}, 0.3), "smooth": ({"steps": 0.65}, 0.4),
        "copied": ({"corr": 0.99, "error": 0.1}, 0.2 + 0.1 + 0.08), "ahead": ({"hold": 0.9}, 0.9 + 0.8 * 1.5), "spiky": ({"spike": 0.1}, 0.5),
    }
    df = spark.createDataFrame([{**row, **c, "spec_id": n} for n, (c, _) in cases.items()])
    got = {r.spec_id: r.score for r in gsc.penalised(df).collect()}
    assert all(abs(got[n] - want) < 1e-6 for n, (_, want) in cases.items())


def test_growing_penalties_shrink_more():
    rng = np.random.default_rng(5)
    y = np.outer(rng.random(6) + 1, rng.random(20) + 1) * 10
    mask = np.full(y.shape, True)
    mask[0, 15:] = False
    x = np.stack([np.broadcast_to(np.sin(np.arange(20)), y.shape)], axis=2)
    plain, grown = (gsc.complete(y, mask, x, 2, 0.5, 0.01, growth=g, cap=3.0) for g in (1.0, 1.25))
    assert not np.allclose(plain, grown) and np.allclose(plain, gsc.complete(y, mask, x, 2, 0.5, 0.01))


def test_final_run_finds_a_planted_effect(spark):
    rows = episode_rows(spark, drop=2.0)
    specs = gsc.grid(rows, (2,), (0.001,)).withColumn("covariates", F.lit(False))
    cf = gsc.final_run(rows, specs, gsc.folds(rows), embargo=2, bags=2, calibrate_last=6, smooth_half=0)
    assert abs(metrics.att(cf).first().att_mean + 2) < 0.5 and cf.agg(F.min("mu0_hat")).first()[0] >= 0
    assert cf.count() == rows.filter("is_victim = 1").count()


def test_search_sets_are_seeded_and_bounded():
    for model, bounds in meta.SEARCH.items():
        sets = meta.random_params(model, 20)
        assert sets == meta.random_params(model, 20) and len({str(s) for s in sets}) > 5
        assert all(low <= s[name] <= high and (isinstance(s[name], int) or not whole) for s in sets for name, low, high, _, whole in bounds)


def test_learners_with_few_treated_rows_and_boosting(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 7, 1, i, "e", x, 2.0 * x + (3.0 if i % 5 == 0 else 0.0), int(i % 5 == 0), float(i % 5 == 0), 1.0) for i, x in enumerate(rng.random(200).tolist())]
    df = spark.createDataFrame(rows, "store_nbr int, item_nbr int, t int, episode_id string, f double, y double, D_bin int, D_cont double, w double")
    for spec in (meta.Learner(["f"], params={"regParam": 1e-4}), meta.Learner(["f"], model="boosting", propensity="boosting", params={"maxIter": 10, "maxDepth": 3}, propensity_params={"maxIter": 3, "maxDepth": 2})):
        for learn in (meta.t_learner, meta.x_learner):
            assert abs(learn(df, df, spec).agg(F.avg("tau_hat")).first()[0] - 3) < 0.6
    few = df.filter("D_bin = 0 OR t < 20")
    x, t = (learn(few, df, meta.Learner(["f"])).orderBy("t").select("tau_hat").toPandas() for learn in (meta.x_learner, meta.t_learner))
    assert np.allclose(x, t)
    assert meta.for_target(df, meta.Learner(["f"])).model == "ridge"
    assert meta.for_target(df.withColumn("y", F.round("y")), meta.Learner(["f"])).model == "poisson"
