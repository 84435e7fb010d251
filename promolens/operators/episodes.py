"""Episode panels: victim and donor rows of each episode, their labels and quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import unit_id
from promolens.functions.shipping import ship_by_value
from promolens.schema import UNIT

ship_by_value(__name__)


def episode_units(ep: DataFrame, donors: DataFrame) -> DataFrame:
    """(episode_id, unit, is_victim) with the episode's windows."""
    window = ["episode_id", "pre_start", "treat_start", "post_start", "post_end"]
    victims = ep.select(*window, F.col("j_store").alias("store_nbr"), F.col("j_item").alias("item_nbr"), F.lit(1).alias("is_victim"))
    controls = donors.filter(F.col("store_nbr").isNotNull()).select("episode_id", *UNIT).join(ep.select(*window), "episode_id")
    return victims.unionByName(controls.select(*window, *UNIT, F.lit(0).alias("is_victim")))


def episode_panel(ep: DataFrame, donors: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows of all episodes: an equality join on the unit, then the window. Labels: treated_unit,
    treated_time (from treat_start on), D their product, is_pre, train_mask, w_episode (1 / rows)."""
    units = episode_units(ep, donors)
    rows = panel.join(units, UNIT).filter(F.col("t").between(F.col("pre_start"), F.col("post_end")))
    rows = rows.withColumn("treated_unit", F.col("is_victim")).withColumn("treated_time", (F.col("t") >= F.col("treat_start")).cast("int"))
    rows = rows.withColumn("D", F.col("treated_unit") * F.col("treated_time")).withColumn("is_pre", 1 - F.col("treated_time")).withColumn("train_mask", 1 - F.col("D"))
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_id"))
    return rows.withColumn("unit_id", unit_id(F.col("store_nbr"), F.col("item_nbr"))).withColumn("w_episode", F.lit(1.0) / n)


def donor_quality(rows: DataFrame, promo_max: float = 0.02, avail_min: float = 0.90, least: float = 0.5) -> DataFrame:
    """Per (episode, unit): promo_share, avail_share, keep and the reason; victims always stay."""
    stats = rows.groupBy("episode_id", *UNIT, "is_victim").agg(F.avg("onpromotion").alias("promo_share"), F.avg((F.col("unit_sales") > least).cast("int")).alias("avail_share"))
    promo, avail = F.col("promo_share") > promo_max, F.col("avail_share") < avail_min
    stats = stats.withColumn("keep", ((F.col("is_victim") == 1) | (~promo & ~avail)).cast("int"))
    reason = F.concat_ws("; ", F.when(promo, F.lit("promo_share")), F.when(avail, F.lit("avail_share")))
    return stats.withColumn("reason", F.when(F.col("is_victim") == 1, F.lit("")).otherwise(reason))


def keep_good_donors(rows: DataFrame, quality: DataFrame) -> DataFrame:
    return rows.join(quality.filter("keep = 1").select("episode_id", *UNIT), ["episode_id", *UNIT], "left_semi")


def discard_reasons(quality: DataFrame, n: int = 10) -> DataFrame:
    parts = quality.filter("keep = 0").select(F.explode(F.transform(F.split("reason", ";"), lambda x: F.trim(x))).alias("reason"))
    return parts.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def episode_counts(rows: DataFrame, donors: DataFrame) -> DataFrame:
    own = rows.groupBy("episode_id").agg(F.count("*").alias("n_rows"), F.countDistinct(F.when(F.col("is_victim") == 0, F.col("unit_id"))).alias("n_donors_kept"))
    given = donors.filter(F.col("store_nbr").isNotNull()).groupBy("episode_id").agg(F.count("*").alias("n_donors_input"))
    return own.join(given, "episode_id", "left")


def victim_vs_donors(rows: DataFrame) -> DataFrame:
    """Per (episode, t): the victim's sales and the donors' mean."""
    out = rows.groupBy("episode_id", "t", "treat_start").agg(
        F.max(F.when(F.col("is_victim") == 1, F.col("unit_sales"))).alias("y_obs"), F.avg(F.when(F.col("is_victim") == 0, F.col("unit_sales"))).alias("mu0_hat")
    )
    return out.filter("y_obs IS NOT NULL AND mu0_hat IS NOT NULL")


def donor_gram(rows: DataFrame) -> DataFrame:
    """Sums of products of donor series (and of each with the victim's) over PRE periods of each episode."""
    pre = rows.filter("is_pre = 1")
    a = pre.filter("is_victim = 0").select("episode_id", "t", F.col("unit_id").alias("a"), F.col("unit_sales").alias("x"))
    b = pre.select("episode_id", "t", F.when(F.col("is_victim") == 0, F.col("unit_id")).otherwise("y").alias("b"), F.col("unit_sales").alias("z"))
    return a.join(b, ["episode_id", "t"]).groupBy("episode_id", "a", "b").agg(F.sum(F.col("x") * F.col("z")).alias("g"))


def ridge_weights(gram: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Donor weights of each episode: a solve of (G + alpha I) w = g with as many unknowns as donors."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        units = sorted(pdf["a"].unique())
        at = {u: i for i, u in enumerate(units)}
        g, c = np.eye(len(units)) * alpha, np.zeros(len(units))
        for a, b, v in zip(pdf["a"], pdf["b"], pdf["g"], strict=True):
            if b == "y":
                c[at[a]] = v
            else:
                g[at[a], at[b]] += v
        return pd.DataFrame({"episode_id": pdf["episode_id"].iloc[0], "unit_id": units, "w": np.linalg.solve(g, c)})

    return gram.groupBy("episode_id").applyInPandas(solve, "episode_id string, unit_id string, w double")


def donor_blend(rows: DataFrame, alpha: float = 1.0, min_pre: int = 3) -> DataFrame:
    """Per (episode, t): y_obs and mu0_hat, the ridge blend of donor sales; absent cells count as 0.
    Episodes with fewer PRE periods than min_pre have none."""
    enough = rows.filter("is_pre = 1").groupBy("episode_id").agg(F.countDistinct("t").alias("n")).filter(F.col("n") >= max(3, min_pre))
    weights = ridge_weights(donor_gram(rows), alpha).join(enough.select("episode_id"), "episode_id", "left_semi")
    blend = rows.filter("is_victim = 0").join(weights, ["episode_id", "unit_id"]).groupBy("episode_id", "t").agg(F.sum(F.col("w") * F.col("unit_sales")).alias("mu0_hat"))
    victim = rows.filter("is_victim = 1").select("episode_id", "t", "treat_start", F.col("unit_sales").alias("y_obs"))
    return victim.join(weights.select("episode_id").distinct(), "episode_id", "left_semi").join(blend, ["episode_id", "t"], "left").withColumn("mu0_hat", F.coalesce("mu0_hat", F.lit(0.0)))


