"""Cleaning and auditing of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions.scalars import is_boolean_like, is_numeric_like, non_negative, promo_flag
from promolens.operators.ranks import quantiles

ISSUE = ["dataset", "check", "severity", "n_affected", "n_rows"]


def since(df: DataFrame, date: str, column: str = "date") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(date).cast("date"))


def strict_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """df with a date column; raises while it runs if a text is no date."""
    parsed = F.try_to_date(F.col(column).cast("string"))
    bad = F.col(column).isNotNull() & parsed.isNull()
    return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("not a date: "), F.col(column).cast("string"))).cast("date")).otherwise(parsed))


def collapse_sales(df: DataFrame, order: Column, others: list[str] = (), rule: str = "text") -> DataFrame:
    """One row per (date, store, item): any promotion, summed sales, the last value of other columns."""
    return df.groupBy("date", "store_nbr", "item_nbr").agg(
        F.max(promo_flag(F.col("onpromotion"), rule)).alias("onpromotion"), F.sum("unit_sales").alias("unit_sales"), *[F.max_by(c, order).alias(c) for c in others]
    )


def collapse_transactions(df: DataFrame, order: Column | None = None, others: list[str] = ()) -> DataFrame:
    return df.groupBy("date", "store_nbr").agg(F.sum("transactions").alias("transactions"), *[F.max_by(c, order).alias(c) for c in others])


def clean_transactions(df: DataFrame) -> DataFrame:
    return df.withColumn("transactions", non_negative(F.col("transactions").cast("string").try_cast("double")))


def sales_summary(panel: DataFrame) -> DataFrame:
    """One row: rows, dates, stores, items, rates, and the least and most rows of a store."""
    stores = panel.groupBy("store_nbr").agg(F.count("*").alias("n"))
    spread = stores.agg(F.min("n").alias("min_store_rows"), F.max("n").alias("max_store_rows"))
    whole = panel.agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("store_nbr").alias("n_stores"), F.countDistinct("item_nbr").alias("n_items"),
        F.avg("onpromotion").alias("promo_rate"), F.avg(F.col("unit_sales").isNull().cast("int")).alias("null_rate"), F.avg((F.col("unit_sales") < 0).cast("int")).alias("negative_rate"),
    )
    return whole.withColumn("k", F.lit(1)).join(spread.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


def transactions_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("store_nbr").alias("n_stores"), F.sum("transactions").alias("transactions"))


def _issue(df: DataFrame, dataset: str, check: str, severity: str, bad: Column) -> DataFrame:
    """One row: how many rows fail a check."""
    return df.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_affected"), F.count("*").alias("n_rows")).select(
        F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n_affected", "n_rows"
    )


def missing_columns(df: DataFrame, dataset: str, required: list[str]) -> DataFrame:
    n = sum(c not in df.columns for c in required)
    return df.sparkSession.createDataFrame([(dataset, "columns", "error", n, len(required))], "dataset string, `check` string, severity string, n_affected long, n_rows long")


def non_numeric(df: DataFrame, dataset: str, column: str) -> DataFrame:
    c = F.col(column)
    return _issue(df, dataset, f"non_numeric_{column}", "error", c.isNotNull() & ~is_numeric_like(c))


def not_boolean(df: DataFrame, dataset: str, column: str = "onpromotion") -> DataFrame:
    c = F.col(column)
    return _issue(df, dataset, f"not_boolean_{column}", "warning", c.isNotNull() & ~is_boolean_like(c))


def duplicate_keys(df: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return _issue(df.groupBy(*keys).count(), dataset, "duplicate_keys", "error", F.col("count") > 1)


def duplicate_samples(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").orderBy(F.desc("count"), *keys).limit(n)


def date_range(df: DataFrame, dataset: str, first: str, last: str) -> DataFrame:
    return _issue(df, dataset, "date_range", "warning", ~F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def weekly_negative(panel: DataFrame, dataset: str = "sales", period: str = "week", least: float = -1.0) -> DataFrame:
    weekly = panel.groupBy(F.date_trunc(period, "date").alias("w"), "store_nbr", "item_nbr").agg(F.sum("unit_sales").alias("s"))
    return _issue(weekly, dataset, "weekly_negative", "warning", F.col("s") < least)


def iqr_bound(df: DataFrame, column: str, k: float = 6.0) -> DataFrame:
    """One row: the upper bound q3 + k x IQR, or the 99.9th percentile where the IQR is 0."""
    q = quantiles(df, column, {"q1": 0.25, "q3": 0.75, "q999": 0.999})
    return q.select(F.when(F.col("q3") > F.col("q1"), F.col("q3") + k * (F.col("q3") - F.col("q1"))).otherwise(F.col("q999")).alias("bound"))


def high_outliers(panel: DataFrame, dataset: str = "sales", column: str = "unit_sales", k: float = 6.0) -> DataFrame:
    bound = iqr_bound(panel, column, k).withColumn("k", F.lit(1))  # one row
    return _issue(panel.withColumn("k", F.lit(1)).join(F.broadcast(bound), "k"), dataset, "high_outliers", "info", F.col(column) > F.col("bound"))


def too_few(df: DataFrame, dataset: str, column: str, least: int) -> DataFrame:
    n = df.agg(F.countDistinct(column).alias("n"))
    return n.select(F.lit(dataset).alias("dataset"), F.lit(f"few_{column}").alias("check"), F.lit("warning").alias("severity"), F.greatest(F.lit(least) - F.col("n"), F.lit(0)).cast("long").alias("n_affected"), F.col("n").alias("n_rows"))


def negative(df: DataFrame, dataset: str, column: str) -> DataFrame:
    return _issue(df, dataset, f"negative_{column}", "warning", F.col(column) < 0)


def coverage_by_store(df: DataFrame) -> DataFrame:
    """Share of all dates that each store has."""
    dates = df.agg(F.countDistinct("date").alias("n_dates")).withColumn("k", F.lit(1))  # one row
    own = df.groupBy("store_nbr").agg(F.countDistinct("date").alias("n_own")).withColumn("k", F.lit(1))
    return own.join(F.broadcast(dates), "k").select("store_nbr", (F.col("n_own") / F.col("n_dates")).alias("coverage"))


def low_coverage(df: DataFrame, dataset: str = "transactions", least: float = 0.9) -> DataFrame:
    return _issue(coverage_by_store(df), dataset, "date_coverage", "warning", F.col("coverage") < least)


def missing_values(df: DataFrame, dataset: str, column: str) -> DataFrame:
    return _issue(df, dataset, f"missing_{column}", "info", F.col(column).isNull())


def invalid_locale(holidays: DataFrame) -> DataFrame:
    return _issue(holidays, "holidays", "invalid_locale", "error", ~F.coalesce(F.col("locale").isin("National", "Regional", "Local"), F.lit(False)))


def unmatched_locales(holidays: DataFrame, stores: DataFrame) -> DataFrame:
    """Regional holidays of no known state and local ones of no known city."""
    out = []
    for locale, column in (("Regional", "state"), ("Local", "city")):
        names = stores.select(F.col(column).alias("locale_name")).distinct()
        out.append(holidays.filter(F.col("locale") == locale).join(names, "locale_name", "left_anti").select("date", "locale", "locale_name"))
    return out[0].unionByName(out[1])


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the facts without a row in the dimension."""
    return facts.select(key).filter(F.col(key).isNotNull()).distinct().join(dimension.select(key).distinct(), key, "left_anti")


def orphan_issue(facts: DataFrame, dimension: DataFrame, dataset: str, key: str) -> DataFrame:
    keys = facts.select(key).distinct()
    known = dimension.select(key).distinct().withColumn("known", F.lit(True))
    return _issue(keys.join(known, key, "left"), dataset, f"orphan_{key}", "error", F.col("known").isNull())


def audit(sales: DataFrame, items: DataFrame, stores: DataFrame, transactions: DataFrame, oil: DataFrame, holidays: DataFrame, first: str, last: str) -> DataFrame:
    """All checks as one table of issues."""
    parts = [
        missing_columns(sales, "sales", ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"]),
        non_numeric(sales, "sales", "unit_sales"), non_numeric(transactions, "transactions", "transactions"),
        not_boolean(sales, "sales"),
        duplicate_keys(sales, "sales", ["date", "store_nbr", "item_nbr"]), duplicate_keys(items, "items", ["item_nbr"]),
        duplicate_keys(stores, "stores", ["store_nbr"]), duplicate_keys(transactions, "transactions", ["date", "store_nbr"]),
        date_range(sales, "sales", first, last), weekly_negative(sales), high_outliers(sales),
        too_few(items, "items", "family", 33), too_few(stores, "stores", "store_nbr", 54),
        negative(transactions, "transactions", "transactions"), low_coverage(transactions),
        missing_values(oil, "oil", "dcoilwtico"), invalid_locale(holidays),
        orphan_issue(sales, items, "sales", "item_nbr"), orphan_issue(sales, stores, "sales", "store_nbr"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pct", F.when(F.col("n_rows") > 0, F.col("n_affected") / F.col("n_rows")).otherwise(0.0))


def markdown(issues: DataFrame) -> DataFrame:
    """The issues as lines of a Markdown table."""
    return issues.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ISSUE]), F.lit(" |")).alias("line"))
