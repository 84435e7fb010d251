"""Readers and writers of the flows' tables. Formats follow the path's extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions.scalars import promo_flag
from promolens.schema import HOLIDAYS, ITEMS, OIL, PANEL, STORES, TRANSACTIONS, first_existing, nan_to_null, rename_synonyms, require_columns

#: Names under which columns occur.
PANEL_SYNONYMS = {"item_nbr": ("item_id", "item"), "store_nbr": ("store_id", "store"), "unit_sales": ("sales", "units"), "onpromotion": ("promo", "on_promotion")}
CF_SYNONYMS = {"y_obs": ("obs", "sales", "y"), "mu0_hat": ("y_hat", "cf", "counterfactual"), "effect": ("tau", "tau_hat"), "cum_effect": ("cumulative_effect",), "t": ("date",)}


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """CSV (with header), JSON or Parquet by extension; folders and unknown extensions are Parquet."""
    kind = next((k for k in ("csv", "json") if path.rstrip("/").split(".")[-1].lower() in (k, f"{k}l")), "parquet")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}), **options)
    reader = reader.schema(schema) if schema is not None else reader
    return nan_to_null(reader.format(kind).load(path))


def read_under(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A table below a configured root; names that leave the root are refused."""
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{name} is outside {root}")
    return read_any(spark, f"{root.rstrip('/')}/{name}", schema)


def read_panel(spark: SparkSession, path: str, items: DataFrame | None = None, rule: str = "text", raw: bool = False) -> DataFrame:
    """The sales panel: explicit schema for CSV, synonyms renamed, promotion absent means 0, items joined."""
    df = rename_synonyms(read_any(spark, path, None if raw or not path.endswith("csv") else PANEL), PANEL_SYNONYMS)
    require_columns(df, ["date", "store_nbr", "item_nbr", "unit_sales"], path)
    df = df.withColumn("onpromotion", promo_flag(F.col("onpromotion"), rule) if "onpromotion" in df.columns else F.lit(0))
    return df if items is None else df.join(items, "item_nbr", "left")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_any(spark, path, ITEMS if path.endswith("csv") else None).select("item_nbr", "family", "class", "perishable")


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    return read_any(spark, path, STORES if path.endswith("csv") else None)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    df = read_any(spark, path, TRANSACTIONS if path.endswith("csv") else None)
    return df.withColumn("transactions", F.coalesce(F.col("transactions").cast("string").try_cast("double"), F.lit(0.0)))


def read_oil(spark: SparkSession, path: str) -> DataFrame:
    from promolens.operators.features import fill_both_ways

    return fill_both_ways(read_any(spark, path, OIL if path.endswith("csv") else None), "dcoilwtico", "dcoilwtico")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    df = read_any(spark, path, HOLIDAYS if path.endswith("csv") else None)
    return df.withColumn("transferred", F.coalesce("transferred", F.lit(False)) if "transferred" in df.columns else F.lit(False))


def read_donors(spark: SparkSession, path: str, kind: str | None = "same_item") -> DataFrame:
    df = read_any(spark, path)
    return df if kind is None else df.filter(F.col("donor_kind") == kind)


def read_metrics(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """All metric files below a folder as one table, tagged with the model."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder).withColumn("model_type", F.lit(model))


def normalise_series(df: DataFrame) -> DataFrame:
    """A counterfactual table under the usual names: synonyms resolved, episode_id from the file's name where
    absent, effect derived, one row per (episode, t)."""
    df = rename_synonyms(df, CF_SYNONYMS)
    if "episode_id" not in df.columns:
        df = df.withColumn("episode_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_cf)?\.[^./]+$", 1))
    if first_existing(df, "effect") is None:
        df = df.withColumn("effect", F.col("y_obs") - F.col("mu0_hat"))
    keys = ["episode_id", *[c for c in ("model_type",) if c in df.columns], "t"]
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """By extension; partition columns make later reads touch their own folders only."""
    kind = "csv" if path.rstrip("/").endswith(".csv") else "parquet"
    writer = df.write.mode(mode).format(kind)
    writer = writer.option("header", "true") if kind == "csv" else writer
    (writer.partitionBy(*partitions) if partitions else writer).save(path)


def write_by_store(exposed: DataFrame, path: str) -> None:
    """The exposure table in a folder per store. Rows of a store meet first, so each folder gets few files; a store
    larger than a partition should be is split. Stores that `exposed` lacks keep what an earlier run has written."""
    dealt = exposed.hint("rebalance", "store_nbr")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_nbr").parquet(path)


def write_both(tables: dict[str, DataFrame], folder: str) -> None:
    """Summary tables as Parquet and CSV side by side."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.parquet")
        write_table(df, f"{folder}/{name}.csv")


def write_stack(stack: DataFrame, folder: str, y_columns: list[str], keys: list[str]) -> None:
    """The meta panel, and its X and Y projections."""
    write_table(stack, f"{folder}/stack")
    write_table(stack.drop(*[c for c in y_columns if c not in keys]), f"{folder}/x")
    write_table(stack.select(*keys, *[c for c in y_columns if c not in keys]), f"{folder}/y")


def report_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per line and episode."""
    report_json(df).write.mode("overwrite").text(path)
