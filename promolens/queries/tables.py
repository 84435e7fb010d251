"""Intermediate tables of the flows, built from the test tables on demand."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.operators import episodes as ep
from promolens.operators import exposure as ex
from promolens.operators import features as ft
from promolens.operators import metrics as mt
from promolens.operators import donors as dn
from promolens.operators import pairs as pr
from promolens.operators import runs as rn
from promolens.plans import gsc, meta
from promolens.schema import Config
from promolens.sources.staging import stage
from promolens.sources.testdata import TestTables


class Tables(TestTables):
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self.cfg = Config.monthly()

    #: Tables that were written to the shared folder, by application, test folder with its state, and name.
    written: ClassVar[dict[tuple[str, str, str, str], DataFrame]] = {}

    @cached_property
    def state(self) -> str:
        """Changes when files of the test folder do."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.dir)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return "|".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Few rows from a deep plan: written once per application, then read by whatever needs them."""
        key = (self.spark.sparkContext.applicationId, self.dir, self.state, name)
        if key not in self.written:
            self.written[key] = stage(build(), name)
        return self.written[key]

    @cached_property
    def sales(self) -> DataFrame:
        return self.panel()

    @cached_property
    def exposed(self) -> DataFrame:
        return ex.exposure(self.sales, self.cfg.bin_threshold)

    @cached_property
    def found_runs(self) -> DataFrame:
        return rn.runs(self.sales, self.cfg.min_run, self.cfg.window)

    @cached_property
    def raw_sales(self) -> DataFrame:
        """Order lines as an uncleaned sales table, with text flags."""
        return self.lines().withColumn("onpromotion", F.when(F.col("l_discount") >= 0.09, "True").otherwise("False")).withColumn("unit_sales", F.col("l_quantity"))

    @cached_property
    def base(self) -> DataFrame:
        return pr.candidate_base(self.exposed, self.sales)

    @cached_property
    def cannibals(self) -> DataFrame:
        return pr.cannibal_candidates(self.base, self.cfg)

    @cached_property
    def victims(self) -> DataFrame:
        return pr.victim_candidates(self.base, self.sales, self.cfg)

    @cached_property
    def cannibal_scores(self) -> DataFrame:
        return pr.score_cannibals(self.cannibals, self.exposed, self.found_runs)

    @cached_property
    def top_cannibals(self) -> DataFrame:
        return pr.top_cannibals(self.cannibal_scores, self.cfg.top_cannibals)

    @cached_property
    def victim_scores(self) -> DataFrame:
        return pr.score_victims(self.top_cannibals, self.victims, self.exposed, self.found_runs)

    @cached_property
    def all_episodes(self) -> DataFrame:
        return pr.episodes(pr.top_victims(self.victim_scores, self.cfg.top_victims), self.found_runs, self.cfg)

    @cached_property
    def victim_windows(self) -> DataFrame:
        return self.all_episodes.select("episode_id", F.col("j_store").alias("store_nbr"), F.col("j_item").alias("item_nbr"), "pre_start", "pre_end")

    @cached_property
    def episodes(self) -> DataFrame:
        return self.staged("episodes", lambda: pr.good_episodes(self.all_episodes, self.sales, self.cfg))

    @cached_property
    def profiles(self) -> DataFrame:
        return dn.profiles(pr.exposure_profile(self.exposed), self.items(), self.stores())

    @cached_property
    def donor_candidates(self) -> DataFrame:
        return dn.candidates(self.episodes, self.profiles, self.cfg.donor_preselect)

    @cached_property
    def donor_stats(self) -> DataFrame:
        return self.staged("donor_stats", lambda: dn.with_stats(self.donor_candidates, self.episodes, self.sales))

    @cached_property
    def chosen(self) -> DataFrame:
        return dn.choose(self.donor_stats, self.cfg)

    @cached_property
    def donor_ranked(self) -> DataFrame:
        return self.staged("donor_ranked", lambda: dn.rank_per_victim(self.chosen, self.cfg.donors))

    @cached_property
    def donors(self) -> DataFrame:
        return dn.per_episode(self.donor_ranked, self.episodes)

    @cached_property
    def universe(self) -> DataFrame:
        """Units that are cannibal, victim or donor of some episode."""
        ep = self.episodes
        units = ep.select(F.col("j_store").alias("store_nbr"), F.col("j_item").alias("item_nbr")).union(ep.select("i_store", "i_item"))
        return units.union(self.donors.filter("store_nbr IS NOT NULL").select("store_nbr", "item_nbr")).distinct()

    @cached_property
    def features(self) -> DataFrame:
        return ft.feature_panel(self.sales, self.items(), self.stores(), self.transactions(), self.oil(), self.holidays(), self.cfg.lags)

    @cached_property
    def rows(self) -> DataFrame:
        return self.staged("rows", lambda: ep.episode_panel(self.episodes, self.donors, self.sales))

    @cached_property
    def quality(self) -> DataFrame:
        return ep.donor_quality(self.rows, self.cfg.donor_promo_max, self.cfg.donor_avail_min, 40)

    @cached_property
    def cf(self) -> DataFrame:
        """Donor-mean series, the simplest counterfactual."""
        return ep.victim_vs_donors(self.rows).withColumn("model_type", F.lit("DONOR"))

    @cached_property
    def cells(self) -> DataFrame:
        return mt.with_effect(self.cf).filter("t >= treat_start").select("episode_id", "t", "effect")

    @cached_property
    def smd(self) -> DataFrame:
        return mt.balance(self.rows, ["unit_sales", "onpromotion"])

    @cached_property
    def draws(self) -> DataFrame:
        """Each donor's effect against the mean of the episode's other donors."""
        w = Window.partitionBy("episode_id", "t")
        others = F.count(F.lit(1)).over(w) - 1
        d = self.rows.filter("is_victim = 0").withColumn("mu0_hat", F.when(others > 0, (F.sum("unit_sales").over(w) - F.col("unit_sales")) / others))
        d = d.filter("t >= treat_start AND mu0_hat IS NOT NULL")
        return d.groupBy("episode_id", "unit_id").agg(F.avg(F.col("unit_sales") - F.col("mu0_hat")).alias("att")).withColumn("model_type", F.lit("DONOR"))

    @cached_property
    def loo_draws(self) -> DataFrame:
        """The victim's effect against the mean of all donors but one, by the donor left out."""
        w = Window.partitionBy("episode_id", "t")
        others = F.count(F.lit(1)).over(w) - 1
        d = self.rows.filter("is_victim = 0").withColumn("mu0_hat", F.when(others > 0, (F.sum("unit_sales").over(w) - F.col("unit_sales")) / others))
        d = d.join(self.cf.select("episode_id", "t", "y_obs"), ["episode_id", "t"]).filter("t >= treat_start AND mu0_hat IS NOT NULL")
        return d.groupBy("episode_id", "unit_id").agg(F.avg(F.col("y_obs") - F.col("mu0_hat")).alias("att")).withColumn("model_type", F.lit("DONOR"))

    @cached_property
    def spec_draws(self) -> DataFrame:
        """The victim's effect under each way to treat the donor mean: as it is, moved to PRE's level, regressed on PRE, smoothed."""
        kinds = {"plain": self.cf, "level": mt.level_calibration(self.cf, 6), "ols": mt.ols_calibration(self.cf), "smooth": mt.smooth(self.cf)}
        parts = [mt.att(df).select("episode_id", "model_type", F.lit(kind).alias("spec_id"), F.col("att_mean").alias("att")) for kind, df in kinds.items()]
        return reduce(DataFrame.union, parts)

    @cached_property
    def gsc_cf(self) -> DataFrame:
        return self.staged("gsc_cf", lambda: gsc.as_series(gsc.counterfactual(self.rows, self.best_spec)))

    @cached_property
    def gsc_draws(self) -> DataFrame:
        return self.staged("gsc_draws", lambda: self._gsc(gsc.counterfactual(self.rows, gsc.random_specs(self.rows, 6))))

    @cached_property
    def gsc_loo(self) -> DataFrame:
        return self.staged("gsc_loo", lambda: self._gsc(gsc.leave_one_out(self.rows, self.best_spec)))

    @cached_property
    def gsc_placebos(self) -> DataFrame:
        return self.staged("gsc_placebos", lambda: self._gsc(gsc.placebo_space(self.rows, self.best_spec)))

    def _gsc(self, fitted: DataFrame) -> DataFrame:
        return gsc.effects(fitted).withColumn("model_type", F.lit("GSC"))

    @cached_property
    def placebos(self) -> DataFrame:
        return mt.placebo(self.draws, mt.att(self.cf))

    @cached_property
    def two_models(self) -> DataFrame:
        att = mt.att(self.cf)
        ols = mt.att(mt.ols_calibration(self.cf).withColumn("model_type", F.lit("OLS"))).filter("n_post > 5")
        return att.unionByName(ols)

    @cached_property
    def best_spec(self) -> DataFrame:
        return self.staged("best_spec", lambda: gsc.select_spec(self.rows, gsc.grid(self.rows), gsc.folds(self.rows)))

    stack_features = ("l1", "l2", "roll", "promo", "H", "season_sin", "season_cos")

    @cached_property
    def stack(self) -> DataFrame:
        """Episode rows with lagged features, exposure and weights, for the meta-learners."""
        w = Window.partitionBy("store_nbr", "item_nbr").orderBy("t")
        past = w.rowsBetween(-6, -1)
        season = F.col("t") * (2 * 3.141592653589793 / 12)
        feats = self.exposed.select("store_nbr", "item_nbr", "t", F.lag("unit_sales", 1).over(w).alias("l1"), F.lag("unit_sales", 2).over(w).alias("l2"), F.avg("unit_sales").over(past).alias("roll"), F.col("onpromotion").cast("double").alias("promo"), F.coalesce("H_prop_raw", F.lit(0.0)).alias("H"), F.sin(season).alias("season_sin"), F.cos(season).alias("season_cos"))
        rows = self.rows.join(feats, ["store_nbr", "item_nbr", "t"]).withColumn("y", F.col("unit_sales"))
        return self.staged("stack", lambda: meta.sample_weights(meta.treatment(rows, "D")).na.fill(0.0))
