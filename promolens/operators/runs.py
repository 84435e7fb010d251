"""Promotion runs: consecutive treated rows of a unit, and their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.schema import UNIT, Config


def islands(df: DataFrame, flag: str = "onpromotion", time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """df with __island: equal for rows of a unit whose flag doesn't change in between (present rows only)."""
    own = Window.partitionBy(*unit).orderBy(time)
    same = Window.partitionBy(*unit, flag).orderBy(time)
    return df.withColumn("__island", F.row_number().over(own) - F.row_number().over(same))


def runs(df: DataFrame, min_run: int = 1, window: tuple[int, int] | None = None, flag: str = "onpromotion", time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """Runs of at least min_run treated rows: run_start, run_end, n."""
    if window:
        df = df.filter(F.col(time).between(*window))
    found = islands(df, flag, time, unit).filter(F.col(flag) == 1).groupBy(*unit, "__island")
    return found.agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("n")).filter(F.col("n") >= min_run).drop("__island")


def first_runs(found: DataFrame, unit: list[str] = UNIT) -> DataFrame:
    """The earliest run of each unit."""
    return found.groupBy(*unit).agg(F.min(F.struct("run_start", "run_end")).alias("r")).select(*unit, "r.run_start", "r.run_end")


def gap_runs(df: DataFrame, min_run: int = 1, max_gap: int = 0, flag: str = "onpromotion", time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """Runs on an integer calendar that tolerate up to max_gap untreated periods in between. A run is as long as it
    spans, tolerated periods included; n counts the treated ones."""
    w = Window.partitionBy(*unit).orderBy(time)
    on = df.filter(F.col(flag) == 1)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > max_gap + 1).cast("int"), F.lit(1))
    marked = on.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    found = marked.groupBy(*unit, "__run").agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("n"))
    return found.filter(F.col("run_end") - F.col("run_start") + 1 >= min_run).drop("__run")


def run_lengths(found: DataFrame) -> DataFrame:
    return found.groupBy("n").agg(F.count("*").alias("runs"))


def run_mask(df: DataFrame, found: DataFrame, name: str = "in_run", time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """df with 1 where a row lies inside a run of its unit. Runs of a unit don't overlap, so rows don't multiply."""
    r = found.select(*[F.col(c).alias(f"__{c}") for c in unit], "run_start", "run_end")
    on = [F.col(c) == F.col(f"__{c}") for c in unit] + [F.col(time).between(F.col("run_start"), F.col("run_end"))]
    joined = df.join(r, on, "left")
    return joined.withColumn(name, F.col("run_start").isNotNull().cast("int")).drop(*[f"__{c}" for c in unit], "run_start", "run_end")


def with_edges(df: DataFrame, found: DataFrame, time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """df with opens and closes: 1 on the first and on the last row of a run of the unit. Runs start and end at rows;
    where a unit has several rows at one time, each is marked."""
    edges = F.array(F.struct(F.col("run_start").alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct(F.col("run_end").alias("at"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))
    flat = found.select(*unit, F.explode(edges).alias("e")).groupBy(*unit, F.col("e.at").alias(time)).agg(F.max("e.opens").alias("opens"), F.max("e.closes").alias("closes"))
    return df.join(flat, [*unit, time], "left").na.fill(0, ["opens", "closes"])


def zero_streaks(df: DataFrame, value: str = "unit_sales", name: str = "zero_streak", time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """Number of rows without sales up to and including this one; 0 where something was sold."""
    marked = islands(df.withColumn("__zero", (F.coalesce(value, F.lit(0.0)) <= 0).cast("int")), "__zero", time, unit)
    w = Window.partitionBy(*unit, "__zero", "__island").orderBy(time)
    return marked.withColumn(name, F.when(F.col("__zero") == 1, F.row_number().over(w)).otherwise(0)).drop("__zero", "__island")


def windows(start: Column, end: Column, cfg: Config) -> dict[str, Column]:
    """Episode windows in periods, from a run's start and end."""
    treat_end = F.least(end, start + (cfg.treat_max - 1))
    return {
        "pre_start": start - (cfg.pre + cfg.gap), "pre_end": start - (cfg.gap + 1), "treat_start": start, "treat_end": treat_end,
        "post_start": treat_end + 1, "post_end": treat_end + cfg.post,
    }


def role_calendar(episodes: DataFrame, guard: int = 1) -> DataFrame:
    """(episode_id, t, role): each period of an episode once; where windows overlap the first of treat,
    guard_pre, guard_post, pre, post wins."""
    spans = [("treat", 0, "treat_start", "treat_end", 0, 0), ("guard_pre", 1, "treat_start", "treat_start", -guard, -1), ("guard_post", 2, "treat_end", "treat_end", 1, guard), ("pre", 3, "pre_start", "pre_end", 0, 0), ("post", 4, "post_start", "post_end", 0, 0)]
    parts = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("priority"), (F.col(a) + x).alias("a"), (F.col(b) + y).alias("b")) for r, p, a, b, x, y in spans])
    rows = episodes.select("episode_id", F.explode(parts).alias("s")).filter("s.a <= s.b")
    rows = rows.select("episode_id", "s.role", "s.priority", F.explode(F.sequence("s.a", "s.b")).alias("t"))
    return rows.groupBy("episode_id", "t").agg(F.min_by("role", "priority").alias("role"))
