"""Tables behind exploratory figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import hash_order
from promolens.operators.ranks import buckets


def daily_counts(panel: DataFrame, value: str = "unit_sales", rows: int = 7) -> DataFrame:
    """Rows and total per date with a trailing mean of the total, computed on the one-row-per-date table."""
    daily = panel.groupBy("date").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(rows - 1), 0)
    return daily.withColumn("trend", F.avg("total").over(w))


def missing_shares(df: DataFrame) -> DataFrame:
    """column, share of nulls: one pass."""
    cols = df.columns
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in cols])).alias("r")).select("r.column", "r.share")


def promo_rate_by(panel: DataFrame, *keys) -> DataFrame:
    return panel.groupBy(*keys).agg(F.avg("onpromotion").alias("promo_rate"), F.count("*").alias("n"))


def promo_transitions(panel: DataFrame) -> DataFrame:
    """2 x 2 shares of the next row's flag given this one's; absent combinations are 0."""
    w = Window.partitionBy("store_nbr", "item_nbr").orderBy("t")
    moved = panel.withColumn("prev", F.lag("onpromotion").over(w)).filter("prev IS NOT NULL")
    counts = moved.groupBy("prev").agg(F.sum(1 - F.col("onpromotion")).alias("n0"), F.sum("onpromotion").alias("n1"), F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(c).alias("curr"), F.col(f"n{c}").alias("n"), (F.col(f"n{c}") / F.col("n")).alias("share")) for c in (0, 1)])
    return counts.select("prev", F.explode(cells).alias("c")).select("prev", "c.curr", "c.n", "c.share")


def promo_crowding(panel: DataFrame) -> DataFrame:
    """How many (store, date) cells have so many items on promotion."""
    cells = panel.groupBy("store_nbr", "date").agg(F.sum("onpromotion").alias("items_on"))
    return cells.groupBy("items_on").agg(F.count("*").alias("cells"))


def top_promo_groups(panel: DataFrame, items: DataFrame, n: int) -> DataFrame:
    return promo_rate_by(panel.drop("class").join(items, "item_nbr"), "family").orderBy(F.desc("promo_rate"), "family").limit(n)


def panel_overview(panel: DataFrame, least: float = 0.5) -> DataFrame:
    return panel.groupBy("date").agg(F.sum("unit_sales").alias("sales"), F.avg("onpromotion").alias("promo_share"), F.avg((F.col("unit_sales") > least).cast("int")).alias("availability"))


def quality_shares(quality: DataFrame, promo_max: float, avail_min: float) -> DataFrame:
    return quality.filter("is_victim = 0").agg(F.avg((F.col("promo_share") <= promo_max).cast("int")).alias("promo_ok"), F.avg((F.col("avail_share") >= avail_min).cast("int")).alias("avail_ok"), F.avg("keep").alias("kept"))


def episode_summary(counts: DataFrame, index: DataFrame) -> DataFrame:
    """Medians of donor retention (with IQR) and of window lengths."""
    ratio = F.col("n_donors_kept") / F.col("n_donors_input")
    return counts.join(index, "episode_id").agg(
        F.percentile(ratio, 0.5).alias("retention"), (F.percentile(ratio, 0.75) - F.percentile(ratio, 0.25)).alias("retention_iqr"), F.percentile("pre_days", 0.5).alias("pre_days"), F.percentile("post_days", 0.5).alias("post_days")
    )


def episode_quality(index: DataFrame, donors: DataFrame, min_pre: int = 60, min_post: int = 30, min_donors: int = 5, min_same_item: float = 0.6) -> DataFrame:
    """Six flags per episode, their sum and a label (5 and more: Alta, 3 and more: Media, else Baja)."""
    per = donors.filter("store_nbr IS NOT NULL").groupBy("episode_id").agg(
        F.count("*").alias("n_donors"), F.avg((F.col("donor_kind") == "same_item").cast("int")).alias("same_item_share"), F.percentile("distance", 0.5).alias("median_distance")
    )
    whole = per.agg(F.percentile("median_distance", 0.5).alias("typical")).withColumn("k", F.lit(1))  # one row
    df = index.join(per, "episode_id", "left").withColumn("k", F.lit(1)).join(F.broadcast(whole), "k").drop("k")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    flags = [
        flag(F.col("pre_days") >= min_pre), flag(F.col("post_days") >= min_post), flag((F.col("pre_start") < F.col("treat_start")) & (F.col("treat_start") < F.col("post_start")) & (F.col("post_start") <= F.col("post_end"))),
        flag(F.col("n_donors") >= min_donors), flag(F.col("same_item_share") >= min_same_item), flag(F.col("median_distance") <= F.col("typical")),
    ]
    df = df.withColumn("score", sum(flags[1:], flags[0]))
    return df.withColumn("label", F.when(F.col("score") >= 5, "Alta").when(F.col("score") >= 3, "Media").otherwise("Baja"))


def sales_buckets(units: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Units in n equal buckets by value; ties by id. One row per unit."""
    return buckets(units, [value, "store_nbr", "item_nbr"], n, "bucket")


def stratified_sample(episodes: DataFrame, strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """n episodes spread over the strata: the first of each in hash order, then the second, and so on."""
    order = hash_order(seed, F.col("episode_id"))
    w = Window.partitionBy(*strata).orderBy(order)
    return episodes.withColumn("turn", F.row_number().over(w)).orderBy("turn", order).limit(n).drop("turn")


def example_episodes(counts: DataFrame, n: int = 3) -> DataFrame:
    return counts.orderBy(F.desc("n_donors_kept"), F.desc("n_rows"), "episode_id").limit(n)
