"""Pairs of a promoted item and an affected item, and the episodes they define."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import episode_id, hash_order
from promolens.operators.runs import first_runs, windows, with_edges
from promolens.schema import UNIT, Config


def _share_moments(share: Column) -> tuple[Column, Column]:
    """Mean and population deviation (0 without values) of shares from -1 to 1, as aggregates. Whole numbers of
    1e-15 are summed as decimals, so units with equal shares get equal results, in whatever order their rows come."""
    whole = F.round(share * 1e15).cast("decimal(16,0)")
    mean = F.avg(whole)
    variance = (F.avg(whole * whole) - mean * mean).cast("double")
    return mean.cast("double") / 1e15, F.sqrt(F.greatest(variance, F.lit(0.0))) / 1e15


def exposure_profile(exposed: DataFrame, value: str = "H_prop_raw") -> DataFrame:
    """Per unit: n_obs (rows, also without a value), p_any, h_mean, h_sd (population) of shares."""
    x = F.col(value)
    mean, sd = _share_moments(x)
    return exposed.groupBy(*UNIT, "class").agg(
        F.count("*").alias("n_obs"), F.coalesce(F.avg((x > 0).cast("int")), F.lit(0.0)).alias("p_any"), mean.alias("h_mean"), sd.alias("h_sd")
    )


def group_metrics(exposed: DataFrame, value: str = "H_prop_raw") -> DataFrame:
    """The same by sample deviation, counting values only."""
    x = F.col(value)
    return exposed.groupBy(*UNIT, "class").agg(F.count(x).alias("n_obs_H"), F.avg(x).alias("h_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("h_sd"), F.avg((x > 0).cast("int")).alias("p_any"))


def promo_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*UNIT).agg(
        F.count("*").alias("n_rows"), F.sum("onpromotion").alias("n_on"), F.avg("onpromotion").alias("p_promo"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )


def collapse_exposure(exposed: DataFrame) -> DataFrame:
    """One row per unit and period: mean share, any flag."""
    return exposed.groupBy(*UNIT, "t").agg(F.avg("H_prop_raw").alias("H_prop"), F.max("H_bin").alias("H_bin"))


def candidate_base(exposed: DataFrame, panel: DataFrame) -> DataFrame:
    return exposure_profile(exposed).join(promo_profile(panel), UNIT, "left")


def eligible(base: DataFrame, cfg: Config) -> DataFrame:
    """Units with enough, varied and neither constant nor absent exposure."""
    return base.filter((F.col("n_obs") >= cfg.min_item_obs) & (F.col("h_sd") >= cfg.h_sd_min) & F.col("p_any").between(*cfg.p_any))


def large_groups(base: DataFrame, least: int = 2) -> DataFrame:
    """Units of neighbourhoods that hold at least `least` units."""
    n = F.count(F.lit(1)).over(Window.partitionBy("store_nbr", "class"))
    return base.withColumn("group_size", n).filter(F.col("group_size") >= least)


def cannibal_candidates(base: DataFrame, cfg: Config) -> DataFrame:
    return large_groups(eligible(base, cfg)).filter(F.col("p_promo").between(*cfg.p_promo_i))


def victim_candidates(base: DataFrame, panel: DataFrame, cfg: Config) -> DataFrame:
    """Eligible units that are seldom on promotion themselves within the window of runs."""
    inside = panel.filter(F.col("t").between(*cfg.window)).groupBy(*UNIT).agg(F.avg("onpromotion").alias("p_window"))
    return large_groups(eligible(base, cfg)).join(inside, UNIT).filter(F.col("p_window") <= cfg.p_promo_j_max)


def sample_groups(base: DataFrame, fraction: float = 0.25, cap: int = 50, seed: int = 42) -> DataFrame:
    """A hash-ordered share of each neighbourhood, at most `cap` units."""
    w = Window.partitionBy("store_nbr", "class")
    order = w.orderBy(hash_order(seed, F.col("store_nbr"), F.col("item_nbr")))
    keep = F.least(F.ceil(F.count(F.lit(1)).over(w) * fraction), F.lit(cap))
    return base.withColumn("__n", F.row_number().over(order)).withColumn("__keep", keep).filter("__n <= __keep").drop("__n", "__keep")


SHARE_UNITS = 10**12  # shares are summed as whole numbers of so many parts: sums are exact up to 9 million periods


def _whole(share: Column) -> Column:
    return F.round(share * SHARE_UNITS).cast("long")


def _contrast(on: str, n_on: str, off: str, n_off: str) -> Column:
    """The mean on run periods less that on the others, from sums of whole numbers."""
    return (F.col(on) / F.col(n_on) - F.col(off) / F.col(n_off)) / SHARE_UNITS


def score_cannibals(candidates: DataFrame, exposed: DataFrame, found: DataFrame, exact: bool = True) -> DataFrame:
    """delta_H_cls: the neighbourhood's mean exposure on the unit's run periods less that on all others.

    exact leaves the unit itself out of the mean. The neighbourhood's means, and what leaving the unit out
    changes in them, are summed up to each of the unit's rows, so that a run is two lookups: before its
    first row and at its last. Runs start and end at rows of the unit, as those of runs() do.
    """
    calendar = Window.partitionBy("store_nbr", "class").orderBy("t")
    groups = exposed.groupBy("store_nbr", "class", "t").agg(F.sum("H_prop_raw").alias("s"), F.count("H_prop_raw").alias("c"))
    groups = groups.withColumn("m", F.coalesce(_whole(F.col("s") / F.col("c")), F.lit(0))).withColumn("k", (F.col("c") > 0).cast("long"))
    groups = groups.withColumn("m_upto", F.sum("m").over(calendar)).withColumn("k_upto", F.sum("k").over(calendar))
    rows = candidates.select(*UNIT, "class").join(exposed.select(*UNIT, "t", F.col("H_prop_raw").alias("x")), UNIT).join(groups, ["store_nbr", "class", "t"])
    if exact:
        n = F.col("c") - F.col("x").isNotNull().cast("int")
        m = F.when(n > 0, _whole((F.col("s") - F.coalesce("x", F.lit(0.0))) / n)).otherwise(0)
        rows = rows.withColumn("dm", m - F.col("m")).withColumn("dk", (n > 0).cast("long") - F.col("k"))
    else:
        rows = rows.withColumns({"dm": F.lit(0).cast("long"), "dk": F.lit(0).cast("long")})
    own = Window.partitionBy(*UNIT).orderBy("t")
    rows = with_edges(rows, found)
    aggs = []
    for total, change, upto, name in (("m", "dm", "m_upto", "on"), ("k", "dk", "k_upto", "n_on")):
        rows = rows.withColumn(f"to_{name}", F.col(upto) + F.sum(change).over(own))
        before = F.col(f"to_{name}") - F.col(total) - F.col(change)
        aggs += [F.sum(F.col("closes") * F.col(f"to_{name}") - F.col("opens") * before).alias(name), F.sum(change).alias(f"all_{name}")]
    whole = groups.groupBy("store_nbr", "class").agg(F.sum("m").alias("m"), F.sum("k").alias("k"))
    scored = rows.groupBy(*UNIT, "class").agg(*aggs).join(whole, ["store_nbr", "class"])
    scored = scored.withColumn("off", F.col("m") + F.col("all_on") - F.col("on")).withColumn("n_off", F.col("k") + F.col("all_n_on") - F.col("n_on"))
    return scored.filter("n_on > 0 AND n_off > 0").select(*UNIT, "class", "n_on", "n_off", _contrast("on", "n_on", "off", "n_off").alias("delta_H_cls"))


def top_cannibals(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("delta_H_cls"), *UNIT).limit(n)


def score_victims(cannibals: DataFrame, victims: DataFrame, exposed: DataFrame, found: DataFrame, allow_overlap: bool = False) -> DataFrame:
    """delta_H_j for every (i, j) of a neighbourhood: j's mean exposure on i's run periods less that on the
    others, without the periods of j's own runs unless they may overlap.

    A victim's series is one row of sums up to each period of its calendar, a cannibal one row of runs, so
    the join gives a row per pair and each run is two lookups in it.
    """
    spans = found.groupBy("store_nbr", F.col("item_nbr").alias("i_item")).agg(F.collect_list(F.struct("run_start", "run_end")).alias("spans"))
    none = F.array().cast("array<struct<run_start:bigint,run_end:bigint>>")
    i = cannibals.select("store_nbr", "class", F.col("item_nbr").alias("i_item")).join(spans, ["store_nbr", "i_item"], "left")
    i = i.withColumn("spans", F.coalesce(F.col("spans").cast("array<struct<run_start:bigint,run_end:bigint>>"), none))
    own = Window.partitionBy(*UNIT).orderBy("t")
    j = victims.select(*UNIT).join(exposed.select(*UNIT, "class", "t", F.col("H_prop_raw").alias("x")), UNIT)
    if allow_overlap:
        j = j.withColumn("free", F.lit(True))
    else:
        j = with_edges(j, found)
        j = j.withColumn("free", F.sum(F.col("opens") - F.col("closes")).over(own) + F.col("closes") == 0)
    x = F.when(F.col("free"), F.col("x"))
    j = j.withColumn("sum", F.coalesce(F.sum(_whole(x)).over(own), F.lit(0))).withColumn("n", F.count(x).over(own)).withColumn("periods", F.coalesce(F.lead("t").over(own) - F.col("t"), F.lit(1)).cast("int"))
    packed = j.groupBy(*UNIT, "class").agg(F.max("free").alias("free"), F.min("t").cast("long").alias("first"), F.array_sort(F.collect_list(F.struct("t", "periods", "sum", "n"))).alias("rows"))

    def each_period(name: str) -> Column:
        return F.flatten(F.transform("rows", lambda r: F.array_repeat(r[name], r["periods"]))).alias(name)

    packed = packed.filter("free").select("store_nbr", "class", F.col("item_nbr").alias("j_item"), "first", each_period("sum"), each_period("n"))
    both = i.join(packed, ["store_nbr", "class"]).filter("i_item <> j_item")

    def upto(name: str, t: Column) -> Column:
        at = F.least(t - F.col("first"), F.size(name).cast("long") - 1).cast("int")
        return F.when(at < 0, F.lit(0).cast("long")).otherwise(F.col(name)[at])

    def within(name: str) -> Column:
        return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, r: acc + upto(name, r["run_end"]) - upto(name, r["run_start"] - 1))

    last = {name: F.element_at(name, -1) for name in ("sum", "n")}
    out = both.select("store_nbr", "class", "i_item", "j_item", within("sum").alias("on"), within("n").alias("n_obs_i_on"), last["sum"].alias("all"), last["n"].alias("n"))
    out = out.withColumn("off", F.col("all") - F.col("on")).withColumn("n_obs_i_off", F.col("n") - F.col("n_obs_i_on"))
    delta = F.when((F.col("n_obs_i_on") > 0) & (F.col("n_obs_i_off") > 0), _contrast("on", "n_obs_i_on", "off", "n_obs_i_off"))
    return out.select("store_nbr", "class", "i_item", "j_item", "n_obs_i_on", "n_obs_i_off", delta.alias("delta_H_j"))


def top_victims(scored: DataFrame, n: int) -> DataFrame:
    """The n highest per cannibal, and only then those seen on either side."""
    w = Window.partitionBy("store_nbr", "i_item").orderBy(F.desc_nulls_last("delta_H_j"), "j_item")
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.filter("n_obs_i_on > 0 AND n_obs_i_off > 0")


def episodes(pairs: DataFrame, found: DataFrame, cfg: Config) -> DataFrame:
    """One episode per pair, from the cannibal's first run."""
    first = first_runs(found).withColumnRenamed("item_nbr", "i_item")
    ep = pairs.join(first, ["store_nbr", "i_item"]).withColumns(windows(F.col("run_start"), F.col("run_end"), cfg))
    ep = ep.withColumn("i_store", F.col("store_nbr")).withColumn("j_store", F.col("store_nbr")).drop("store_nbr", "run_start", "run_end")
    return ep.withColumn("episode_id", episode_id(*[F.col(c) for c in ("i_store", "i_item", "j_store", "j_item", "treat_start")]))


def window_stats(units: DataFrame, panel: DataFrame, value: str = "unit_sales") -> DataFrame:
    """Per (episode_id, unit) of `units`, over the periods pre_start..pre_end: n, mean, sd (population), min,
    max, p95, zero_share, cv, coverage (of the window's periods)."""
    rows = units.select("episode_id", *UNIT, "pre_start", "pre_end").join(panel.select(*UNIT, "t", F.col(value).alias("x")), UNIT)
    rows = rows.filter(F.col("t").between(F.col("pre_start"), F.col("pre_end")))
    mean, sd = F.avg("x"), F.stddev_pop("x")
    return rows.groupBy("episode_id", *UNIT).agg(
        F.count("x").alias("n_pre"), mean.alias("pre_mean"), sd.alias("pre_sd"), F.min("x").alias("pre_min"), F.max("x").alias("pre_max"), F.percentile("x", 0.95).alias("pre_p95"),
        F.avg((F.col("x") == 0).cast("int")).alias("zero_share"), F.when(F.abs(mean) > 1e-9, sd / mean).alias("cv"), (F.count("x") / F.max(F.col("pre_end") - F.col("pre_start") + 1)).alias("coverage"),
    )


def pre_quality(stats: DataFrame, cfg: Config) -> DataFrame:
    return stats.filter((F.col("coverage") >= cfg.pre_coverage) & (F.col("pre_sd") >= cfg.pre_sd_min) & (F.abs("pre_mean") >= cfg.pre_mean_min))


def easy(stats: DataFrame, cfg: Config) -> DataFrame:
    return stats.filter((F.col("zero_share") <= cfg.pre_zero_max) & (F.coalesce("cv", F.lit(0.0)) <= cfg.pre_cv_max))


def good_episodes(ep: DataFrame, panel: DataFrame, cfg: Config) -> DataFrame:
    """Episodes whose victim's PRE window is covered, varied and not mostly empty."""
    stats = window_stats(ep.select("episode_id", F.col("j_store").alias("store_nbr"), F.col("j_item").alias("item_nbr"), "pre_start", "pre_end"), panel)
    return ep.join(easy(pre_quality(stats, cfg), cfg).select("episode_id"), "episode_id", "left_semi")


def subset(ep: DataFrame, how: str, n: int, seed: int = 42, allowed: DataFrame | None = None) -> DataFrame:
    """n episodes: top_delta_abs, first, random (by hash) or explicit (a table of episode_id)."""
    keys = ["i_store", "i_item", "j_store", "j_item", "treat_start", "episode_id"]
    if how == "explicit":
        return ep.join(allowed.select("episode_id").distinct(), "episode_id", "left_semi")
    order = {"top_delta_abs": [F.desc(F.abs("delta_H_j")), *keys], "first": keys, "random": [hash_order(seed, F.col("episode_id"))]}[how]
    return ep.orderBy(*order).limit(n)


def frequent(ep: DataFrame, n_cannibals: int, n_victims: int) -> DataFrame:
    """Episodes of the most frequent cannibals, and of each the n_victims highest."""
    count = F.count(F.lit(1)).over(Window.partitionBy("i_store", "i_item"))
    ranked = ep.withColumn("n_pairs", count)
    ranked = ranked.join(_ranked_units(ep, n_cannibals), ["i_store", "i_item"], "left_semi")
    w = Window.partitionBy("i_store", "i_item").orderBy(F.desc("delta_H_j"), "j_store", "j_item")
    return ranked.withColumn("v", F.row_number().over(w)).filter(F.col("v") <= n_victims).drop("v")


def _ranked_units(ep: DataFrame, n: int) -> DataFrame:
    return ep.groupBy("i_store", "i_item").count().orderBy(F.desc("count"), "i_store", "i_item").limit(n)


def episode_index(ep: DataFrame) -> DataFrame:
    """One row per episode_id with unit ids and effective lengths."""
    w = Window.partitionBy("episode_id").orderBy(F.desc("delta_H_j"), "i_item")
    one = ep.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return one.select(
        "episode_id", F.concat_ws(":", "i_store", "i_item").alias("i_unit"), F.concat_ws(":", "j_store", "j_item").alias("j_unit"), "class", "pre_start", "treat_start", "post_start", "post_end",
        F.greatest(F.col("treat_start") - F.col("pre_start"), F.lit(0)).alias("pre_days"), F.greatest(F.col("post_end") - F.col("post_start") + 1, F.lit(0)).alias("post_days"),
    )
