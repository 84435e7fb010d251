"""Competitive exposure: how much of a unit's neighbourhood is on promotion."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.operators.ranks import counted_quantiles, value_counts
from promolens.schema import UNIT
from promolens.sources.staging import stage


def exposure(panel: DataFrame, threshold: float = 0.02, neighbourhood: str = "class", include_self: bool = False) -> DataFrame:
    """panel with H_prop_raw (share of the others on promotion, null when alone), H_disc and H_bin.

    One window per (date, store, neighbourhood): no self-join, one shuffle.
    """
    group = Window.partitionBy("date", "store_nbr", neighbourhood)
    own = F.lit(0) if include_self else F.col("onpromotion")
    on = F.sum("onpromotion").over(group) - own
    others = F.count(F.lit(1)).over(group) - (0 if include_self else 1)
    df = panel.withColumn("H_disc", on.cast("int")).withColumn("__others", others)
    df = df.withColumn("H_prop_raw", F.when(F.col("__others") > 0, F.col("H_disc") / F.col("__others")))
    return df.withColumn("H_bin", (F.coalesce("H_prop_raw", F.lit(0.0)) >= threshold).cast("int")).drop("__others")


def class_mean_without(df: DataFrame, value: str = "H_prop_raw", group: str = "class", name: str = "H_class_loo") -> DataFrame:
    """Mean of the neighbourhood's other values on the same date: (sum - x) / (count - 1)."""
    w = Window.partitionBy("date", "store_nbr", group)
    n = F.count(value).over(w) - F.col(value).isNotNull().cast("int")
    total = F.sum(value).over(w) - F.coalesce(value, F.lit(0.0))
    return df.withColumn(name, F.when(n > 0, total / n))


def ema_alpha(alpha: float | None = None, halflife: float | None = None, span: float | None = 7) -> float:
    if alpha is not None:
        return alpha
    if halflife is not None:
        return 1 - 0.5 ** (1 / halflife)
    return 2 / (span + 1)


SCAN_BLOCK = 64  # states that one fold gathers


def _scan(rows: str, begin: Column, step, kind: str, out=lambda s: s) -> Column:
    """out of the state after each of the rows, which step follows from `begin`. Adding to an array copies it,
    so the states of a block are gathered first, and the blocks then."""
    bind = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  the value is computed once
    none = lambda t: F.array().cast(f"array<{t}>")

    def one(acc: Column, r: Column) -> Column:
        return bind(step(acc["s"], r), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(out(s))).alias("out")))

    def block(acc: Column, i: Column) -> Column:
        some = F.aggregate(F.slice(rows, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), F.struct(acc["s"].alias("s"), none(kind).alias("out")), one)
        return bind(some, lambda b: F.struct(b["s"].alias("s"), F.concat(acc["out"], F.array(b["out"])).alias("out")))

    each = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / SCAN_BLOCK).cast("int"))
    return F.flatten(F.aggregate(each, F.struct(begin.alias("s"), none(f"array<{kind}>").alias("out")), block, lambda acc: acc["out"]))


def _ema_start() -> Column:
    """The mean so far, none, and its weight."""
    return F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("w"))


def _ema_step(value: str, alpha: float):
    def step(s: Column, r: Column) -> Column:
        x, w = r[value].cast("double"), s["w"] * (1 - alpha)
        y = F.when(x.isNull(), s["y"]).when(s["y"].isNull(), x).otherwise((w * s["y"] + alpha * x) / (w + alpha))
        weight = F.when(x.isNull() & s["y"].isNotNull(), w).otherwise(F.lit(1.0))
        return F.struct(y.alias("y"), weight.alias("w"))

    return step


def ema(df: DataFrame, value: str, name: str, alpha: float, time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    """Exponential mean per unit in time order. A missing value carries the last mean on and lets its
    weight decay; leading missing values stay missing. A group is one unit's series: for series that are
    too long for a row, ema_of_long_series() gives the same."""
    keep = [c for c in df.columns if c not in unit]
    rows = F.array_sort(F.collect_list(F.struct(time, *[c for c in keep if c != time])))
    series = df.groupBy(*unit).agg(rows.alias("__rows"))
    series = series.withColumn("__y", _scan("__rows", _ema_start(), _ema_step(value, alpha), "double", lambda s: s["y"]))
    return _with_means(series, df.columns, unit, name)


def _with_means(series: DataFrame, columns: list[str], unit: list[str], name: str) -> DataFrame:
    """A row for each of __rows, with its value of __y."""
    flat = series.select(*unit, F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__y").alias("y"))).alias("z"))
    return flat.select(*[F.col(c) if c in unit else F.col(f"z.r.{c}").alias(c) for c in columns if c != name], F.col("z.y").alias(name))


def ema_of_long_series(df: DataFrame, value: str, name: str, alpha: float, time: str = "t", unit: list[str] = UNIT, piece: int = 4096) -> DataFrame:
    """ema() where a unit may hold any share of the rows.

    Rows are dealt by ranges of (unit, time) and cut into pieces of at most `piece` rows. From its first
    present value on, the mean at a piece's end is an affine function of the mean at that value, so a
    piece is summed up in six numbers; a unit's sums, one row, tell where each of its pieces starts.
    """
    keep = [c for c in df.columns if c not in unit]
    rest = [c for c in keep if c != time]
    dealt = stage(df.repartitionByRange(*unit, time).withColumn("__part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy(*unit, "__part").orderBy(time, *rest)
    dealt = dealt.withColumn("__piece", F.floor((F.row_number().over(inside) - 1) / piece).cast("int"))
    keys = [*unit, "__part", "__piece"]
    pieces = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(time, *rest))).alias("__rows"))
    mean = _ema_step(value, alpha)

    # lead: rows up to the first present value, x; slope: of the mean at the end in the mean at x, which was x
    def add(s: Column, r: Column) -> Column:
        here, later = r[value].isNotNull(), s["y"].isNotNull()
        w = s["w"] * (1 - alpha)
        after = mean(s, r)
        return F.struct(
            F.when(later, s["lead"]).otherwise(s["lead"] + 1).alias("lead"), F.coalesce(s["x"], r[value].cast("double")).alias("x"),
            F.when(here & later, s["slope"] * w / (w + alpha)).otherwise(s["slope"]).alias("slope"), after["y"].alias("y"), after["w"].alias("w"))

    none = _ema_start()
    nothing = F.struct(F.lit(0).alias("lead"), F.lit(None).cast("double").alias("x"), F.lit(1.0).alias("slope"), none["y"].alias("y"), none["w"].alias("w"))

    def pass_piece(s: Column, p: Column) -> Column:
        w = s["w"] * F.pow(F.lit(1 - alpha), p["lead"])
        at_x = (w * s["y"] + alpha * p["x"]) / (w + alpha)
        y = F.when(p["x"].isNull(), s["y"]).when(s["y"].isNull(), p["y"]).otherwise(p["y"] + p["slope"] * (at_x - p["x"]))
        weight = F.when(p["x"].isNotNull(), p["w"]).when(s["y"].isNull(), F.lit(1.0)).otherwise(w)
        return F.struct(y.alias("y"), weight.alias("w"))

    sums = pieces.select(*keys, F.aggregate("__rows", nothing, add).alias("__sum")).select(*keys, "__sum.*")
    chains = sums.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("__part", "__piece", "lead", "x", "slope", "y", "w"))).alias("__sums"))
    chains = chains.withColumn("__ends", _scan("__sums", _ema_start(), pass_piece, "struct<y:double,w:double>"))
    chain = F.transform("__sums", lambda p, i: F.struct(p["__part"].alias("part"), p["__piece"].alias("piece"), F.when(i > 0, F.get("__ends", i - 1)).otherwise(_ema_start()).alias("start")))
    starts = chains.select(*[F.col(c).alias(f"__{c}") for c in unit], F.explode(chain).alias("__c"))
    same = [pieces[c].eqNullSafe(starts[f"__{c}"]) for c in unit]
    met = pieces.join(starts, reduce(and_, [pieces["__part"] == starts["__c.part"], pieces["__piece"] == starts["__c.piece"], *same]))
    met = met.withColumn("__y", _scan("__rows", F.col("__c.start"), mean, "double", lambda s: s["y"]))
    return _with_means(met, df.columns, unit, name)


def trailing_mean(df: DataFrame, value: str, name: str, rows: int, time: str = "t", unit: list[str] = UNIT) -> DataFrame:
    w = Window.partitionBy(*unit).orderBy(time).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


def winsorise(df: DataFrame, value: str, name: str, by: list[str], low: float = 0.005, high: float = 0.995, min_obs: int = 30) -> DataFrame:
    """value within its group's quantiles; groups of fewer than min_obs values use the whole table's.

    Two small tables of quantiles are joined back.
    """
    counts = stage(value_counts(df, value, by), "counts")
    whole = counted_quantiles(counts, {"__glo": low, "__ghi": high}, []).drop("n").withColumn("__k", F.lit(1))  # one row
    if by:
        groups = counted_quantiles(counts, {"lo": low, "hi": high}, by)
        groups = groups.select(*by, F.when(F.col("n") >= min_obs, F.col("lo")).alias("__lo"), F.when(F.col("n") >= min_obs, F.col("hi")).alias("__hi"))
        df = df.join(groups, by, "left")
    else:
        df = df.withColumns({"__lo": F.lit(None).cast("double"), "__hi": F.lit(None).cast("double")})
    df = df.withColumn("__k", F.lit(1)).join(F.broadcast(whole), "__k", "left")
    lo, hi = F.coalesce("__lo", "__glo"), F.coalesce("__hi", "__ghi")
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), lo), hi))).drop("__k", "__lo", "__hi", "__glo", "__ghi")


def exposure_summary(df: DataFrame, value: str = "H_prop_raw") -> DataFrame:
    x = F.col(value)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x == 0).cast("int")).alias("zero_share"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, n, share, cdf of values in 0..1; the running sum is over the bins."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("bin", "n", (F.col("n") / F.sum("n").over(total)).alias("share"), (F.sum("n").over(upto) / F.sum("n").over(total)).alias("cdf"))


def by_date(df: DataFrame, value: str = "H_prop_raw") -> DataFrame:
    return df.groupBy("date").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) == 0).cast("int")).alias("zero_share"))


def by_store(df: DataFrame, value: str = "H_prop_raw") -> DataFrame:
    return df.groupBy("store_nbr").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def top_stores(df: DataFrame, n: int, value: str = "H_prop_raw", min_obs: int = 30) -> DataFrame:
    """The stores with most values, ties by mean."""
    return by_store(df, value).filter(F.col("n") >= min_obs).orderBy(F.desc("n"), F.desc("mean"), "store_nbr").limit(n)


def matrix_stores(df: DataFrame, n: int, value: str = "H_prop_raw") -> list[int]:
    """The n stores with most values, as the columns of a matrix: the largest mean of daily means first."""
    top = top_stores(df, n, value, 1).select("store_nbr")
    daily = df.join(top, "store_nbr", "left_semi").groupBy("store_nbr", "date").agg(F.avg(value).alias("mean"))
    means = daily.groupBy("store_nbr").agg(F.avg("mean").alias("mean"))
    return [r["store_nbr"] for r in means.orderBy(F.desc("mean"), "store_nbr").collect()]  # n rows


def date_store_matrix(df: DataFrame, stores: list[int], value: str = "H_prop_raw") -> DataFrame:
    """Mean by date, a column per store in the order given."""
    out = df.filter(F.col("store_nbr").isin(stores)).groupBy("date").pivot("store_nbr", stores).agg(F.avg(value))
    return out.select("date", *[F.col(f"`{s}`").alias(f"store_{s}") for s in stores])
