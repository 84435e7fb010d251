"""Control units (donors) for the victim of each episode."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import donor_score, donor_side, profile_distance
from promolens.operators.pairs import window_stats
from promolens.schema import UNIT, Config


def profiles(exposure_stats: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """Unit profiles with class and store attributes; the dimensions are small and joined as such."""
    stats = exposure_stats.select(*UNIT, "h_mean", "h_sd", "p_any")
    return stats.join(items.select("item_nbr", "class"), "item_nbr", "left").join(stores.select("store_nbr", "type", "city", "state"), "store_nbr", "left")


PROFILE = ("h_mean", "h_sd", "p_any")
GRID_BITS = (3, 6)  # per axis of the grids over a class's profiles, each inside the one before
NO_PROFILE = -(1 << 40)  # cell of missing values, farther than all others
DISTANCE_DIGITS = 12  # distances are rounded, so that equal ones are ties whatever the last bits of their terms
DISTANCE_STEP = 10.0**-DISTANCE_DIGITS


def _grid(prof: DataFrame, bits: int) -> DataFrame:
    """prof with its cell on each axis, c0 to c2; a cell is 2^-bits wide."""
    return prof.withColumns({f"c{a}": F.coalesce(F.floor(F.col(x) * (1 << bits)), F.lit(NO_PROFILE)) for a, x in enumerate(PROFILE)})


def near_cells(victim: DataFrame, grid: DataFrame, bits: tuple[int, ...] = GRID_BITS) -> DataFrame:
    """The cells of the finest grid that may hold one of the `need` profiles nearest to a victim.

    victim: episode_id, class, need, v_h_mean, v_h_sd, v_p_any; grid: profiles with d_class under _grid(). Cells are
    taken by their farthest corner until they hold `need` profiles; that corner's distance bounds the search,
    and cells whose nearest corner lies beyond it go, grid by grid. A victim without a profile keeps all cells.
    """
    axes = ["c0", "c1", "c2"]
    finest = grid.groupBy("d_class", *axes).agg(F.count("*").alias("n"))
    met = None
    for level in bits:
        up = bits[-1] - level
        cells = finest.groupBy("d_class", *[F.shiftright(c, up).alias(c) for c in axes]).agg(F.sum("n").alias("n"))
        if met is None:
            met = victim.join(cells, victim["class"] == cells["d_class"])
        else:
            inside = [F.shiftright(F.col(f"c.{c}"), level - above) == F.col(f"m.{c}") for c in axes]
            met = met.drop("n").alias("m").join(cells.alias("c"), [F.col("m.d_class") == F.col("c.d_class"), *inside]).select(*[f"m.{c}" for c in victim.columns], "c.*")
        above, side = level, float(1 << level)
        low = [F.col(c) / side - F.col(f"v_{x}") for c, x in zip(axes, PROFILE, strict=True)]
        high = [F.col(f"v_{x}") - (F.col(c) + 1) / side for c, x in zip(axes, PROFILE, strict=True)]
        near = profile_distance(*[F.greatest(a, b, F.lit(0.0)) for a, b in zip(low, high, strict=True)])
        far = profile_distance(*[F.greatest(F.abs(a), F.abs(b)) for a, b in zip(low, high, strict=True)])
        known = reduce(lambda a, b: a & b, [F.col(f"v_{x}").isNotNull() for x in PROFILE])
        met = met.withColumn("near", F.when(known, near).otherwise(0.0)).withColumn("far", F.when(known, far).otherwise(float("inf")))
        one = Window.partitionBy("episode_id")
        met = met.withColumn("upto", F.sum("n").over(one.orderBy("far")))  # cells as far as each other count together
        met = met.withColumn("reach", F.min(F.when(F.col("upto") >= F.col("need"), F.col("far"))).over(one))
        met = met.filter(F.col("reach").isNull() | (F.col("near") <= F.col("reach") * (1 + 1e-9) + 2 * DISTANCE_STEP)).drop("near", "far", "upto", "reach")
    return met.drop("n", "class", "need")


def candidates(ep: DataFrame, prof: DataFrame, preselect: int) -> DataFrame:
    """Nearest profiles per episode and kind: the same item in other stores, and other items of the class
    in other stores; equally near ones go by store and item, those without a profile come last. The same item is
    looked up whole (one unit a store). Of a class an episode reads the cells near its victim that hold
    `preselect` profiles beside those that don't qualify."""
    victim = ep.select("episode_id", "i_store", "j_store", "j_item", "pre_start", "pre_end", "class").join(
        prof.select(F.col("store_nbr").alias("j_store"), F.col("item_nbr").alias("j_item"), *[F.col(c).alias(f"v_{c}") for c in PROFILE]), ["j_store", "j_item"]
    )
    donor = prof.select(*UNIT, F.col("class").alias("d_class"), *PROFILE, "type", "city", "state")
    elsewhere = (F.col("store_nbr") != F.col("j_store")) & (F.col("store_nbr") != F.col("i_store"))
    same_item = victim.join(donor, victim["j_item"] == donor["item_nbr"]).filter(elsewhere).withColumn("donor_kind", F.lit("same_item"))
    # units of the class that don't qualify: those of either store and those of the item
    of_store = prof.groupBy("class", F.col("store_nbr").alias("j_store")).agg(F.count("*").alias("of_j"))
    of_item = prof.groupBy("class", F.col("item_nbr").alias("j_item")).agg(F.count("*").alias("of_item"))
    asked = victim.join(of_store, ["class", "j_store"], "left").join(of_store.select("class", F.col("j_store").alias("i_store"), F.col("of_j").alias("of_i")), ["class", "i_store"], "left")
    asked = asked.join(of_item, ["class", "j_item"], "left").withColumn("need", F.lit(preselect) + sum(F.coalesce(c, F.lit(0)) for c in ("of_j", "of_i", "of_item")))
    grid = _grid(donor, GRID_BITS[-1])
    cells = near_cells(asked.select("episode_id", "class", "need", *[f"v_{c}" for c in PROFILE]).distinct(), grid).select("episode_id", "d_class", "c0", "c1", "c2")
    near = cells.join(grid, ["d_class", "c0", "c1", "c2"]).drop("c0", "c1", "c2").join(victim, "episode_id")
    same_class = near.filter((F.col("class") == F.col("d_class")) & elsewhere & (F.col("item_nbr") != F.col("j_item"))).withColumn("donor_kind", F.lit("same_class"))
    both = same_item.unionByName(same_class)
    d = profile_distance(F.col("h_mean") - F.col("v_h_mean"), F.col("h_sd") - F.col("v_h_sd"), F.col("p_any") - F.col("v_p_any"))
    w = Window.partitionBy("episode_id", "donor_kind").orderBy(F.asc_nulls_last("distance"), *UNIT)
    near = both.withColumn("distance", F.round(d, DISTANCE_DIGITS)).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= preselect)
    return near.select("episode_id", "j_store", "j_item", *UNIT, "donor_kind", "distance", "type", "city", "state", "pre_start", "pre_end")


def with_stats(cand: DataFrame, ep: DataFrame, panel: DataFrame) -> DataFrame:
    """Candidates with their own and the victim's PRE statistics (v_*)."""
    names = ("pre_mean", "pre_sd", "pre_min", "pre_max", "pre_p95", "coverage")
    own = window_stats(cand, panel).select("episode_id", *UNIT, *names)
    victims = ep.select("episode_id", F.col("j_store").alias("store_nbr"), F.col("j_item").alias("item_nbr"), "pre_start", "pre_end")
    v = window_stats(victims, panel).select("episode_id", *[F.col(n).alias(f"v_{n}") for n in names])
    return cand.join(own, ["episode_id", *UNIT]).join(v, "episode_id")


def hard_filters(df: DataFrame, cfg: Config) -> DataFrame:
    """Coverage, spread and level limits against the victim; a limit is skipped where the victim has no level."""

    def within(own: str, victim: str, times: float, least: float = 0.0) -> Column:
        v = F.col(victim)
        return F.when(v > least, F.col(own) <= times * v).otherwise(True)

    level = F.when(F.abs("v_pre_mean") > 1e-6, F.abs(F.col("pre_mean") - F.col("v_pre_mean")) <= F.abs("v_pre_mean")).otherwise(True)
    return df.filter(
        (F.col("coverage") >= cfg.donor_coverage) & (F.col("pre_sd") >= cfg.pre_sd_min) & (F.col("pre_min") >= 0)
        & within("pre_mean", "v_pre_mean", 4.0) & within("pre_p95", "v_pre_p95", 5.0) & within("pre_max", "v_pre_max", 8.0) & level & within("pre_sd", "v_pre_sd", 3.0, 1e-6)
    )


def scored(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumn("score", donor_score(F.col("pre_mean"), F.col("v_pre_mean"), F.col("distance"), alpha)).withColumn("side", donor_side(F.col("pre_mean"), F.col("v_pre_mean")))


def balanced_pick(df: DataFrame, kind: str, slots: Column, each: Column, unique_store: bool) -> DataFrame:
    """The best by score: `each` of either side first, the rest by score, `slots` in all; with unique_store a
    store counts once."""
    df = df.filter(F.col("donor_kind") == kind)
    if unique_store:
        one = Window.partitionBy("episode_id", "store_nbr").orderBy("score", *UNIT)
        df = df.withColumn("__s", F.row_number().over(one)).filter("__s = 1").drop("__s")
    side = Window.partitionBy("episode_id", "side").orderBy("score", *UNIT)
    tier = (F.row_number().over(side) > each).cast("int")
    order = Window.partitionBy("episode_id").orderBy("__tier", "score", *UNIT)
    picked = df.withColumn("__slots", slots).withColumn("__tier", tier).withColumn("__n", F.row_number().over(order))
    return picked.filter("__n <= __slots").drop("__tier", "__n", "__slots")


def choose(stats: DataFrame, cfg: Config) -> DataFrame:
    """Same-item donors for up to 60 % of the slots, same-class ones for the rest, and where filters left
    fewer than the target the nearest profiles without them."""
    n_item = math.ceil(0.6 * cfg.donors)
    good = scored(hard_filters(stats, cfg), cfg.donor_alpha)
    first = balanced_pick(good, "same_item", F.lit(n_item), F.lit(max(3, n_item // 2)), True)
    taken = first.groupBy("episode_id").agg(F.count("*").alias("taken"))
    rest = good.join(taken, "episode_id", "left").withColumn("slots", F.lit(cfg.donors) - F.coalesce("taken", F.lit(0)))
    half = F.greatest(F.lit(3), F.floor(F.col("slots") / 2))
    second = balanced_pick(rest, "same_class", F.col("slots"), half, False).drop("taken", "slots")
    picked = first.unionByName(second).withColumn("fallback", F.lit(0))
    have = picked.groupBy("episode_id").agg(F.count("*").alias("have"))
    others = scored(stats, cfg.donor_alpha).join(picked.select("episode_id", *UNIT), ["episode_id", *UNIT], "left_anti").join(have, "episode_id", "left")
    w = Window.partitionBy("episode_id").orderBy(F.when(F.col("donor_kind") == "same_class", 0).otherwise(1), "distance", *UNIT)
    fill = others.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= F.lit(cfg.donors) - F.coalesce("have", F.lit(0)))
    return picked.unionByName(fill.drop("__n", "have").withColumn("fallback", F.lit(1)))


def rank_per_victim(chosen: DataFrame, k: int) -> DataFrame:
    """Donors of a victim over all its episodes, each once: same item first, then by distance; the first k."""
    kind = F.when(F.col("donor_kind") == "same_item", 0).otherwise(1)
    once = Window.partitionBy("j_store", "j_item", *UNIT).orderBy(kind, "distance", "episode_id")
    one = chosen.withColumn("__o", F.row_number().over(once)).filter("__o = 1").drop("__o", "episode_id")
    w = Window.partitionBy("j_store", "j_item").orderBy(kind, "distance", *UNIT)
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def per_episode(ranked: DataFrame, ep: DataFrame) -> DataFrame:
    """A victim's donors for each of its episodes."""
    return ep.select("episode_id", "j_store", "j_item").join(ranked, ["j_store", "j_item"], "left")


def never_treated(donors: DataFrame, ep: DataFrame) -> DataFrame:
    """Donors that are neither victim nor cannibal of any episode."""
    used = ep.select(F.col("j_store").alias("store_nbr"), F.col("j_item").alias("item_nbr")).union(ep.select("i_store", "i_item")).distinct()
    return donors.join(used, UNIT, "left_anti")


def self_donors(donors: DataFrame) -> DataFrame:
    """One row: how many donors are their own victim, and the share."""
    same = ((F.col("store_nbr") == F.col("j_store")) & (F.col("item_nbr") == F.col("j_item"))).cast("int")
    return donors.agg(F.count("*").alias("n"), F.coalesce(F.sum(same), F.lit(0)).alias("n_self"), F.coalesce(F.avg(same), F.lit(0.0)).alias("share"))
