"""Streams over the panel: fed in parts in the order of time, as files that arrive one after the other."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.queries.registry import query
from promolens.queries.tables import Tables
from promolens.sources.staging import fresh_path
from promolens.streaming import incremental as inc

PARTS = 4


@contextlib.contextmanager
def state_per_core(spark: SparkSession) -> Iterator[None]:
    """Streams started within it keep their state in no more partitions than there are cores: each costs a commit a batch."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrivals(t: Tables, df: DataFrame, name: str, last: DataFrame | None = None) -> Iterator[DataFrame]:
    """A stream of files as it stands after each part of df, by ranges of t, has arrived; `last` comes with the last."""
    path = fresh_path(t.spark, name)
    lo, hi = df.agg(F.min("t"), F.max("t")).first()
    step = (hi - lo) // PARTS + 1 if hi is not None else 1
    for k in range(PARTS):
        part = df.limit(0) if hi is None else df.filter(F.col("t").between(lo + k * step, lo + (k + 1) * step - 1))
        if last is not None and k == PARTS - 1:
            part = part.unionByName(last)
        part.write.mode("append").parquet(path)
        yield t.spark.readStream.schema(df.schema).parquet(path)


def fed_exposure(t: Tables) -> str:
    """The folder of exposure tables kept up by a stream of the panel that is stopped and started after each part.
    Epochs of the first half are merged."""
    path = fresh_path(t.spark, "exposure")
    with state_per_core(t.spark):
        for k, panel in enumerate(arrivals(t, t.sales, "sales"), 1):
            query = inc.stream_exposure(panel, path, late="62 days")
            query.awaitTermination()
            if k == PARTS // 2:
                inc.merge_epochs(t.spark, path, query.lastProgress["batchId"] - 1)
    return path


@query("k1_incremental_exposure", "date:d store_nbr:i item_nbr:i H_disc:i H_prop_raw H_bin:i", "SELECT * FROM exposure")
def _(t: Tables) -> DataFrame:
    return inc.current_exposure(t.spark, fed_exposure(t), t.cfg.bin_threshold)


@query("k1_daily_exposure", "date:d n:i mean zero_share promo_rate", """
  SELECT date, count(H_prop_raw) AS n, avg(H_prop_raw) AS mean, avg((H_prop_raw = 0)::INT) AS zero_share, avg(onpromotion) AS promo_rate FROM exposure GROUP BY date""")
def _(t: Tables) -> DataFrame:
    return inc.exposure_totals(inc.totals(t.spark, fed_exposure(t)), "date")


@query("k1_store_exposure", "store_nbr:i n:i mean zero_share promo_rate", """
  SELECT store_nbr, count(H_prop_raw) AS n, avg(H_prop_raw) AS mean, avg((H_prop_raw = 0)::INT) AS zero_share, avg(onpromotion) AS promo_rate FROM exposure GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return inc.exposure_totals(inc.totals(t.spark, fed_exposure(t)), "store_nbr")


@query("k2_gap_run_stream", "store_nbr:i item_nbr:i run_start:i run_end:i n:i", """
  SELECT store_nbr, item_nbr, min(t) AS run_start, max(t) AS run_end, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) AS run FROM (
      SELECT *, coalesce((t - lag(t) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) > 2)::INT, 1) AS new FROM panel WHERE onpromotion = 1))
  GROUP BY store_nbr, item_nbr, run HAVING max(t) - min(t) + 1 >= 2""")
def _(t: Tables) -> DataFrame:
    """Runs closed by the watermark; an untreated row far ahead closes the last ones."""
    rows = t.sales.select("store_nbr", "item_nbr", "t", "onpromotion")
    ahead = rows.agg(F.max("t").alias("t")).select(F.lit(-1).alias("store_nbr"), F.lit(-1).alias("item_nbr"), (F.col("t") + 10_000).cast("int").alias("t"), F.lit(0).alias("onpromotion"))
    inc.rocksdb_state(t.spark)
    path = fresh_path(t.spark, "gap-runs")
    with state_per_core(t.spark):
        for stream in arrivals(t, rows, "promotions", ahead):
            found = inc.stream_gap_runs(stream, 2, 1, late="2 days")
            out = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(found.schema).parquet(path)
