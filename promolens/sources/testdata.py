"""The sales panel and its side tables from the star-schema test tables.

One month plays the role of one day; nations are stores, brands are items. All joins are with
dimension tables, whose size Spark checks before it broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.functions.scalars import month_index

#: Holidays that stand in for a real calendar.
HOLIDAY_ROWS = [
    ("1997-01-01", "Holiday", "National", "World", "New year", False),
    ("1997-05-01", "Holiday", "Regional", "ASIA", "Founding", False),
    ("1997-07-01", "Additional", "Local", "CHINA", "Fair", False),
    ("1998-01-01", "Holiday", "National", "World", "New year", True),
    ("1998-02-01", "Transfer", "National", "World", "New year moved", False),
    ("1998-12-01", "Bridge", "National", "World", "Bridge", False),
    ("1999-03-01", "Work Day", "National", "World", "Work day", False),
    ("1999-06-01", "Holiday", "Regional", "EUROPE", "Union", False),
    ("2000-01-01", "Holiday", "Local", "BRAZIL", "City", False),
    ("2000-10-01", "Event", "Galactic", "Nowhere", "Odd", None),
]


class TestTables:
    """Lazy readers of one test folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str, grain: str = "month") -> None:
        self.spark, self.dir, self.grain = spark, sf_dir, grain

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """One row per order line: the uncleaned sales table, with several rows per (date, store, item)."""
        date = F.date_trunc(self.grain, "l_shipdate").cast("date")
        item = F.substring("p_brand", 7, 9).cast("int")
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", date.alias("date"))
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), item.alias("item_nbr"))
        suppliers = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("store_nbr"))
        return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")

    def panel(self) -> DataFrame:
        """date, t, store_nbr, item_nbr, class, unit_sales, onpromotion: one row per unit and period."""
        first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"))
        cells = self.lines().groupBy("date", "store_nbr", "item_nbr").agg(F.sum("l_quantity").alias("unit_sales"), first.alias("first"))
        t = month_index(F.col("date")) if self.grain == "month" else F.floor(F.unix_date("date") / 7).cast("int")
        return cells.select("date", t.alias("t"), "store_nbr", "item_nbr", ((F.col("item_nbr") - 1) % 5).alias("class"), "unit_sales", (F.col("first.l_discount") >= 0.09).cast("int").alias("onpromotion"))

    def items(self) -> DataFrame:
        items = self.raw("part").select(F.substring("p_brand", 7, 9).cast("int").alias("item_nbr")).distinct()
        cls = (F.col("item_nbr") - 1) % 5
        return items.select("item_nbr", cls.cast("string").alias("family"), cls.alias("class"), (F.col("item_nbr") % 2).alias("perishable"))

    def stores(self) -> DataFrame:
        regions = self.raw("region").select("r_regionkey", "r_name")
        n = self.raw("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("n_nationkey").cast("int")
        return n.select(key.alias("store_nbr"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.chr(65 + key % 5).alias("type"), (key % 4).alias("cluster"))

    def transactions(self) -> DataFrame:
        return self.lines().groupBy("date", "store_nbr").agg(F.countDistinct("l_orderkey").alias("transactions"))

    def oil(self) -> DataFrame:
        """A price per month; Januaries are missing, as on days without trade."""
        date = F.date_trunc("month", "o_orderdate").cast("date")
        price = self.raw("orders").groupBy(date.alias("date")).agg(F.avg("o_totalprice").alias("price"))
        return price.select("date", F.when(F.month("date") != 1, F.col("price")).alias("dcoilwtico"))

    def holidays(self) -> DataFrame:
        rows = self.spark.createDataFrame(HOLIDAY_ROWS, "date string, type string, locale string, locale_name string, description string, transferred boolean")
        return rows.withColumn("date", F.to_date("date"))
