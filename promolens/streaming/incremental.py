"""Exposure and promotion runs kept up to date by streams.

Exposure: each micro-batch leaves its rows and its counts by (date, store, neighbourhood) under its epoch. A
batch that is replayed overwrites its own folder, so totals are sums over epochs, whatever was repeated, and
leave-one-out shares follow from the totals. Old epochs can be merged into one table of totals.

Runs: a state per unit holds the treated periods of its open runs; a timer closes a run once the watermark has
passed the last period that could still lengthen it, and takes it out of the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from promolens.functions.shipping import ship_by_value
from promolens.schema import UNIT

ship_by_value(__name__)

GROUP = ["date", "store_nbr"]
DAY_MS = 86_400_000
ORIGIN_MS = 946_684_800_000  # period 0 is 2000-01-01: before 1970 every row would count as late


# exposure
def write_epoch(batch: DataFrame, epoch: int, path: str, neighbourhood: str = "class") -> None:
    """A micro-batch's rows and counts, in place of what the same epoch left before."""
    batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
    # counted from what was written, so that both agree even if the batch would come out in another order
    rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows/epoch={epoch}")
    counts = rows.groupBy(*GROUP, neighbourhood).agg(F.count("*").alias("n"), F.sum("onpromotion").alias("on"))
    counts.write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")


def stream_exposure(panel: DataFrame, path: str, late: str = "7 days", neighbourhood: str = "class") -> StreamingQuery:
    """Feed a stream of panel rows to the tables below path, until it holds no more. Rows that come again within
    `late` count once; rows later than that are dropped. After a failure it goes on where it stopped."""
    seen = panel.withColumn("__ts", F.col("date").cast("timestamp")).withWatermark("__ts", late)
    once = seen.dropDuplicatesWithinWatermark(["date", *UNIT]).drop("__ts")
    write = once.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, path, neighbourhood))
    return write.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _merged_upto(spark: SparkSession, path: str) -> int:
    """The last epoch of the newest complete table of merged totals, -1 where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    done = [int(n.removeprefix("upto=")) for n in names if n.startswith("upto=") and _exists(spark, f"{path}/merged/{n}/_SUCCESS")]
    return max(done, default=-1)


def totals(spark: SparkSession, path: str, upto: int | None = None, neighbourhood: str = "class") -> DataFrame:
    """n rows and how many are `on` promotion, by (date, store, neighbourhood)."""
    merged = _merged_upto(spark, path)
    counts = spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts").filter(F.col("epoch") > merged)
    counts = counts if upto is None else counts.filter(F.col("epoch") <= upto)
    counts = counts.drop("epoch")
    if merged >= 0:
        counts = counts.unionByName(spark.read.parquet(f"{path}/merged/upto={merged}"))
    return counts.groupBy(*GROUP, neighbourhood).agg(F.sum("n").alias("n"), F.sum("on").alias("on"))


def merge_epochs(spark: SparkSession, path: str, upto: int, neighbourhood: str = "class") -> None:
    """Add up the counts of the epochs to `upto`, which must not be replayed any more. Readers change over when the
    new table is complete."""
    if upto > _merged_upto(spark, path):
        totals(spark, path, upto, neighbourhood).write.mode("overwrite").parquet(f"{path}/merged/upto={upto}")


def current_exposure(spark: SparkSession, path: str, threshold: float = 0.02, neighbourhood: str = "class") -> DataFrame:
    """The rows so far with H_disc, H_prop_raw and H_bin, as exposure() gives for the whole panel."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("epoch")
    keys = [*GROUP, neighbourhood]
    df = rows.join(totals(spark, path, neighbourhood=neighbourhood), keys).withColumn("H_disc", (F.col("on") - F.col("onpromotion")).cast("int"))
    df = df.withColumn("H_prop_raw", F.when(F.col("n") > 1, F.col("H_disc") / (F.col("n") - 1)))
    return df.withColumn("H_bin", (F.coalesce("H_prop_raw", F.lit(0.0)) >= threshold).cast("int")).drop("n", "on")


def exposure_totals(groups: DataFrame, *by: str) -> DataFrame:
    """n, mean and zero_share of exposure and the share of rows on promotion, from totals() alone.

    In a group of n rows, k of them on promotion, exposures add up to k(n - 1) / (n - 1) = k; they are 0 for all rows
    if k is 0, and for the promoted row alone if k is 1. A row alone in its group has no exposure.
    """
    n, on = F.col("n"), F.col("on")
    zeros: Column = F.when(on == 0, n).when(on == 1, F.lit(1)).otherwise(0)
    several = lambda c: F.sum(F.when(n > 1, c).otherwise(0))
    sums = groups.groupBy(*by).agg(several(n).alias("n"), several(on).alias("__h"), several(zeros).alias("__z"), (F.sum(on) / F.sum(n)).alias("promo_rate"))
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return sums.select(*by, "n", share("__h").alias("mean"), share("__z").alias("zero_share"), "promo_rate")


# runs
class GapRuns(StatefulProcessor):
    """Closes runs of treated periods of one unit; a repeated period counts once."""

    def __init__(self, unit: list[str], min_run: int, max_gap: int, period_ms: int) -> None:
        self.unit, self.min_run, self.max_gap, self.period_ms = unit, min_run, max_gap, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.treated = handle.getMapState("treated", "t bigint", "seen boolean")

    def runs(self) -> list[list[int]]:
        out: list[list[int]] = []
        for t in sorted(k[0] for k in self.treated.keys()):
            if out and t - out[-1][-1] <= self.max_gap + 1:
                out[-1].append(t)
            else:
                out.append([t])
        return out

    def closes(self, run: list[int]) -> int:
        """The first moment at which no period that joins the run can come any more."""
        return ORIGIN_MS + (run[-1] + self.max_gap + 1) * self.period_ms + 1

    def set_timers(self, runs: list[list[int]]) -> None:
        wanted, have = {self.closes(r) for r in runs}, set(self.handle.listTimers())
        for at in have - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - have:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for t in batch["t"].unique():
                self.treated.updateValue((int(t),), (True,))
        self.set_timers(self.runs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for run in self.runs():
            if self.closes(run) <= now:
                for t in run:
                    self.treated.removeKey((t,))
                if run[-1] - run[0] + 1 >= self.min_run:
                    out.append((*key, run[0], run[-1], len(run)))
        if out:
            yield pd.DataFrame(out, columns=[*self.unit, "run_start", "run_end", "n"])

    def close(self) -> None:
        pass


def stream_gap_runs(rows: DataFrame, min_run: int = 1, max_gap: int = 0, late: str = "0 seconds", flag: str = "onpromotion", time: str = "t", unit: list[str] = UNIT, period_ms: int = DAY_MS) -> DataFrame:
    """A stream of closed runs, as gap_runs() finds them in a table, from a stream of rows in any order within `late`.

    `time` counts periods of period_ms. Untreated rows only move the watermark on. The session must keep its state
    in RocksDB: see rocksdb_state().
    """
    ts = F.timestamp_millis(ORIGIN_MS + F.col(time).cast("long") * period_ms)
    # a condition on ts stays above the watermark, so that rows dropped by it have been seen there
    treated = rows.withColumn("ts", ts).withWatermark("ts", late).filter(F.when(F.col("ts").isNotNull(), F.col(flag) == 1)).select(*[F.col(c).cast("long") for c in unit], F.col(time).cast("long").alias("t"), "ts")
    schema = ", ".join(f"{c} long" for c in [*unit, "run_start", "run_end", "n"])
    return treated.groupBy(*unit).transformWithStateInPandas(GapRuns(unit, min_run, max_gap, period_ms), schema, "Append", "EventTime")


def rocksdb_state(spark: SparkSession) -> None:
    """State with timers needs this provider, from the start of a query on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
