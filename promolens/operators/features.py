"""Feature panel: calendar, holidays, traffic, lags, trends, intermittency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.scalars import iso_week
from promolens.schema import UNIT


def _past(keys: list[str], time: str):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(time)


def fill_both_ways(df: DataFrame, value: str, name: str, time: str = "date", keys: list[str] = ()) -> DataFrame:
    """Missing values take the last one before, else the first one after. Without keys the table is one
    short series (a row per date)."""
    w = _past(list(keys), time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.last(value, True).over(back), F.first(value, True).over(ahead)))


def fill_forward(df: DataFrame, value: str, name: str, time: str = "date", keys: list[str] = ()) -> DataFrame:
    """Missing values take the last one before, else 0."""
    w = _past(list(keys), time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(value, True).over(w), F.lit(0.0)))


def weekly_proxies(transactions: DataFrame, oil: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store traffic, oil price) by ISO week: log1p of summed transactions, mean price."""
    week = iso_week(F.col("date")).alias("year_week")
    traffic = transactions.groupBy(week, "store_nbr").agg(F.log1p(F.sum("transactions")).alias("F_state"))
    return traffic, oil.groupBy(week).agg(F.avg("dcoilwtico").alias("O_week"))


def regional_share(transactions: DataFrame, stores: DataFrame) -> DataFrame:
    """A store's share of its state's weekly transactions; null where the state has none."""
    week = iso_week(F.col("date")).alias("year_week")
    own = transactions.groupBy(week, "store_nbr").agg(F.sum("transactions").alias("own")).join(stores.select("store_nbr", "state"), "store_nbr")
    total = F.sum("own").over(Window.partitionBy("year_week", "state"))
    return own.withColumn("R_share", F.when(total > 0, F.col("own") / total)).select("year_week", "store_nbr", "R_share")


def effective_holidays(holidays: DataFrame, keep_transferred: bool = True) -> DataFrame:
    """Without rows of type Transfer; moved holidays stay on their old date unless keep_transferred is off."""
    out = holidays.filter(F.lower("type") != "transfer")
    return out if keep_transferred else out.filter(~F.coalesce("transferred", F.lit(False)))


def holiday_flags(holidays: DataFrame) -> dict[str, DataFrame]:
    """Flag tables: national by date, regional by (date, state), local by (date, city), types by date."""
    h = effective_holidays(holidays)
    day = h.filter(F.col("type").isin("Holiday", "Additional", "Bridge"))
    one = F.lit(1)
    kind = lambda name, text: F.max((F.col("type") == text).cast("int")).alias(name)
    return {
        "national": day.filter("locale = 'National'").groupBy("date").agg(F.max(one).alias("HNat")),
        "regional": day.filter("locale = 'Regional'").groupBy("date", F.col("locale_name").alias("state")).agg(F.max(one).alias("HReg")),
        "local": day.filter("locale = 'Local'").groupBy("date", F.col("locale_name").alias("city")).agg(F.max(one).alias("HLoc")),
        "types": h.groupBy("date").agg(kind("is_bridge", "Bridge"), kind("is_additional", "Additional"), kind("is_work_day", "Work Day")),
    }


def attach_holidays(panel: DataFrame, holidays: DataFrame, stores: DataFrame) -> DataFrame:
    """panel with the flags of its date, state and city, 0 where there is none."""
    f = holiday_flags(holidays)
    df = panel.join(stores.select("store_nbr", "state", "city"), "store_nbr", "left")
    df = df.join(f["national"], "date", "left").join(f["regional"], ["date", "state"], "left").join(f["local"], ["date", "city"], "left").join(f["types"], "date", "left")
    return df.na.fill(0, ["HNat", "HReg", "HLoc", "is_bridge", "is_additional", "is_work_day"])


def attach_proxies(panel: DataFrame, transactions: DataFrame, oil: DataFrame, stores: DataFrame) -> DataFrame:
    """panel with weekly traffic, oil price and regional share, filled forward in their own small tables."""
    traffic, price = weekly_proxies(transactions, oil)
    price = fill_forward(price, "O_week", "O_week", "year_week")
    df = panel.withColumn("year_week", iso_week(F.col("date")))
    df = df.join(fill_forward(traffic, "F_state", "F_state", "year_week", ["store_nbr"]), ["year_week", "store_nbr"], "left").join(price, "year_week", "left")
    return df.join(regional_share(transactions, stores), ["year_week", "store_nbr"], "left").na.fill(0.0, ["F_state", "O_week", "R_share"])


def promo_pressure(panel: DataFrame) -> DataFrame:
    """Per (store, class, t): items, items on promotion, share."""
    return panel.groupBy("store_nbr", "class", "t").agg(F.countDistinct("item_nbr").alias("n_items"), F.sum("onpromotion").alias("n_promo"), F.avg("onpromotion").alias("promo_share"))


def promo_context(panel: DataFrame) -> DataFrame:
    """panel with its neighbourhood's promotion share with and without the unit, by window, not by join."""
    w = Window.partitionBy("store_nbr", "class", "t")
    n, on = F.count(F.lit(1)).over(w), F.sum("onpromotion").over(w)
    return panel.withColumn("promo_share", on / n).withColumn("promo_share_excl", F.when(n > 1, (on - F.col("onpromotion")) / (n - 1)).otherwise(0.0))


def class_index_without(panel: DataFrame) -> DataFrame:
    total = F.sum("unit_sales").over(Window.partitionBy("store_nbr", "class", "t"))
    return panel.withColumn("class_index_excl", F.greatest(total - F.col("unit_sales"), F.lit(0.0)))


def lagged(df: DataFrame, columns: list[str], lags: list[int], keys: list[str] = UNIT, time: str = "t") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumns({f"{c}_l{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def sales_history(df: DataFrame, lags: tuple[int, ...], windows: tuple[int, ...] = (7, 28), least: int = 2) -> DataFrame:
    """Lags of sales, and mean and deviation of the rows before; a window needs `least` rows."""
    df = lagged(df, ["unit_sales"], list(lags))
    order = Window.partitionBy(*UNIT).orderBy("t")
    for n in windows:
        w = order.rowsBetween(-n, -1)
        enough = F.count("unit_sales").over(w) >= least
        df = df.withColumns({f"roll_mean_{n}": F.when(enough, F.avg("unit_sales").over(w)), f"roll_sd_{n}": F.when(enough, F.stddev_samp("unit_sales").over(w))})
    return df


def trend_and_availability(df: DataFrame, rows: int = 7, least: float = 0.5, lags: tuple[int, ...] = (1,)) -> DataFrame:
    """Trailing mean of sales; a unit counts as available where it exceeds `least`."""
    w = Window.partitionBy(*UNIT).orderBy("t").rowsBetween(-(rows - 1), 0)
    df = df.withColumn("trend_T", F.avg("unit_sales").over(w)).withColumn("available_A", (F.col("trend_T") > least).cast("int"))
    return lagged(df, ["trend_T"], list(lags))


def store_trend(df: DataFrame, rows: int = 7, lags: tuple[int, ...] = (1,)) -> DataFrame:
    """(store, t): trailing mean of the store's sales with lags on that grain, to be joined back."""
    daily = df.groupBy("store_nbr", "t").agg(F.sum("unit_sales").alias("store_sales"))
    w = Window.partitionBy("store_nbr").orderBy("t").rowsBetween(-(rows - 1), 0)
    daily = daily.withColumn("Q_store_trend", F.avg("store_sales").over(w))
    return lagged(daily, ["Q_store_trend"], list(lags), ["store_nbr"]).drop("store_sales")


def intermittency(df: DataFrame) -> DataFrame:
    """Per unit: ADI = rows without sales / (rows with sales + 1), CV2 = (sd / (mean + 1e-6))^2."""
    pos = F.sum((F.col("unit_sales") > 0).cast("int"))
    mean, sd = F.avg("unit_sales"), F.stddev_pop("unit_sales")
    return df.groupBy(*UNIT).agg(((F.count("*") - pos) / (pos + 1)).alias("ADI"), F.when(mean > 0, F.pow(sd / (mean + 1e-6), 2)).otherwise(0.0).alias("CV2"))


def dummies(df: DataFrame, column: str, levels: list[str], prefix: str) -> DataFrame:
    """0/1 columns of the sorted levels but the first. Levels come from a dimension table."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(levels)[1:]})


def feature_panel(panel: DataFrame, items: DataFrame, stores: DataFrame, transactions: DataFrame, oil: DataFrame, holidays: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """All features of the panel: controls by small joins, everything else by windows that share the unit's
    or the neighbourhood's partitioning."""
    from promolens.functions.scalars import fourier_terms, month_position, weekday_dummies
    from promolens.operators.runs import zero_streaks

    df = attach_holidays(panel, holidays, stores)
    df = attach_proxies(df, transactions, oil, stores).drop("year_week")
    df = class_index_without(promo_context(df))
    df = lagged(df, ["promo_share", "promo_share_excl", "class_index_excl"], [1, 2])
    df = trend_and_availability(zero_streaks(sales_history(df, lags)))
    df = df.join(store_trend(panel), ["store_nbr", "t"], "left").join(intermittency(panel), UNIT, "left")
    df = df.withColumns({**fourier_terms(F.col("date")), **weekday_dummies(F.col("date")), **month_position(F.col("date"))})
    return df.withColumn("month", F.month("date"))
