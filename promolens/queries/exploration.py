"""Exploratory tables, samples, sources and sinks, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions.scalars import promo_flag
from promolens.operators import eda
from promolens.operators import episodes as ep
from promolens.operators import exposure as ex
from promolens.operators import pairs as pr
from promolens.queries.registry import CTES, query
from promolens.queries.selection import UNIT
from promolens.queries.tables import Tables
from promolens.schema import rename_synonyms, require_columns
from promolens.sources import io
from promolens.sources.staging import fresh_path
from promolens.streaming import events as ev


@query("d37_daily_counts", "date:d n:i total trend", "SELECT *, avg(total) OVER (ORDER BY date ROWS 6 PRECEDING) AS trend FROM (SELECT date, count(*) AS n, sum(unit_sales) AS total FROM panel GROUP BY date)")
def _(t: Tables) -> DataFrame:
    return eda.daily_counts(t.sales)


@query("d38_missing_shares", "column:s share", "SELECT 'H_prop_raw' AS \"column\", avg((H_prop_raw IS NULL)::INT) AS share FROM exposure UNION ALL SELECT 'unit_sales', avg((unit_sales IS NULL)::INT) FROM exposure")
def _(t: Tables) -> DataFrame:
    return eda.missing_shares(t.exposed.select("H_prop_raw", "unit_sales"))


@query("d39_promo_rate_by_date", "date:d promo_rate n:i", "SELECT date, avg(onpromotion) AS promo_rate, count(*) AS n FROM panel GROUP BY date")
def _(t: Tables) -> DataFrame:
    return eda.promo_rate_by(t.sales, "date")


@query("d39_promo_rate_by_weekday", "weekday:i promo_rate n:i", "SELECT isodow(date) - 1 AS weekday, avg(onpromotion) AS promo_rate, count(*) AS n FROM panel GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return eda.promo_rate_by(t.sales, F.weekday("date").alias("weekday"))


@query("d39_promo_rate_by_store", "store_nbr:i promo_rate n:i", "SELECT store_nbr, avg(onpromotion) AS promo_rate, count(*) AS n FROM panel GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return eda.promo_rate_by(t.sales, "store_nbr")


@query("d40_promo_transitions", "prev:i curr:i n:i share", """
  SELECT prev, curr, n, n / sum(n) OVER (PARTITION BY prev) AS share FROM (SELECT prev, onpromotion AS curr, count(*) AS n
  FROM (SELECT *, lag(onpromotion) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) AS prev FROM panel) WHERE prev IS NOT NULL GROUP BY ALL)""")
def _(t: Tables) -> DataFrame:
    return eda.promo_transitions(t.sales)


@query("d41_promo_crowding", "items_on:i cells:i", "SELECT items_on, count(*) AS cells FROM (SELECT sum(onpromotion) AS items_on FROM panel GROUP BY store_nbr, date) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return eda.promo_crowding(t.sales)


@query("d42_top_promo_groups", "family:s promo_rate n:i", "SELECT family, avg(onpromotion) AS promo_rate, count(*) AS n FROM panel JOIN items USING (item_nbr) GROUP BY 1 ORDER BY promo_rate DESC, family LIMIT 3")
def _(t: Tables) -> DataFrame:
    return eda.top_promo_groups(t.sales, t.items(), 3)


@query("d43_panel_overview", "date:d sales promo_share availability", "SELECT date, sum(unit_sales) AS sales, avg(onpromotion) AS promo_share, avg((unit_sales > 40)::INT) AS availability FROM panel GROUP BY date")
def _(t: Tables) -> DataFrame:
    return eda.panel_overview(t.sales, 40)


@query("c23_transactions_join", "date:d " + UNIT + "transactions:i", "SELECT p.date, p.store_nbr, item_nbr, x.transactions FROM panel p LEFT JOIN transactions x ON x.date = p.date AND x.store_nbr = p.store_nbr")
def _(t: Tables) -> DataFrame:
    return t.sales.join(t.transactions(), ["date", "store_nbr"], "left")


@query("b16_projection", "date:d unit_sales onpromotion:i", "SELECT date, unit_sales, onpromotion FROM panel")
def _(t: Tables) -> DataFrame:
    return t.sales.select(*[c for c in ("date", "unit_sales", "onpromotion", "absent") if c in t.sales.columns])


@query("d45_quality_shares", "promo_ok avail_ok kept", "SELECT avg((promo_share <= 0.2)::INT) AS promo_ok, avg((avail_share >= 0.4)::INT) AS avail_ok, avg(keep) AS kept FROM dquality WHERE is_victim = 0")
def _(t: Tables) -> DataFrame:
    return eda.quality_shares(t.quality, 0.2, 0.4)


CTES["ecounts"] = "SELECT episode_id, count(*) AS n_rows, count(DISTINCT unit_id) FILTER (is_victim = 0) AS n_donors_kept FROM erows GROUP BY 1"
CTES["egiven"] = "SELECT episode_id, count(*) AS n_donors_input, avg((donor_kind = 'same_item')::INT) AS same_item_share, quantile_cont(distance, 0.5) AS median_distance FROM donors WHERE store_nbr IS NOT NULL GROUP BY 1"
CTES["eindex"] = "SELECT *, greatest(treat_start - pre_start, 0) AS pre_days, greatest(post_end - post_start + 1, 0) AS post_days FROM episodes"


@query("d46_episode_summary", "retention retention_iqr pre_days post_days", """
  SELECT quantile_cont(r, 0.5) AS retention, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS retention_iqr, quantile_cont(pre_days, 0.5) AS pre_days, quantile_cont(post_days, 0.5) AS post_days
  FROM (SELECT n_donors_kept / n_donors_input::DOUBLE AS r, pre_days, post_days FROM ecounts c JOIN egiven g ON g.episode_id = c.episode_id JOIN eindex i ON i.episode_id = c.episode_id)""")
def _(t: Tables) -> DataFrame:
    return eda.episode_summary(ep.episode_counts(t.rows, t.donors), pr.episode_index(t.episodes))


@query("d47_episode_quality", "episode_id:s n_donors:i same_item_share median_distance score:i label:s", """
  SELECT *, CASE WHEN score >= 5 THEN 'Alta' WHEN score >= 3 THEN 'Media' ELSE 'Baja' END AS label FROM (
    SELECT i.episode_id, n_donors_input AS n_donors, same_item_share, median_distance, (pre_days >= 12)::INT + (post_days >= 6)::INT + (pre_start < treat_start AND treat_start < post_start AND post_start <= post_end)::INT
           + coalesce(n_donors_input >= 5, false)::INT + coalesce(same_item_share >= 0.6, false)::INT + coalesce(median_distance <= (SELECT quantile_cont(median_distance, 0.5) FROM egiven), false)::INT AS score
    FROM eindex i LEFT JOIN egiven g ON g.episode_id = i.episode_id)""")
def _(t: Tables) -> DataFrame:
    return eda.episode_quality(pr.episode_index(t.episodes), t.donors, 12, 6)


@query("f16_example_episodes", "episode_id:s n_donors_kept:i n_rows:i", "SELECT * FROM ecounts ORDER BY n_donors_kept DESC, n_rows DESC, episode_id LIMIT 3")
def _(t: Tables) -> DataFrame:
    return eda.example_episodes(ep.episode_counts(t.rows, t.donors))


@query("e20_sales_buckets", UNIT + "bucket:i", "SELECT store_nbr, item_nbr, ntile(5) OVER (ORDER BY s, store_nbr, item_nbr) AS bucket FROM (SELECT store_nbr, item_nbr, sum(unit_sales) AS s FROM panel GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    return eda.sales_buckets(t.sales.groupBy("store_nbr", "item_nbr").agg(F.sum("unit_sales").alias("s")), "s")


@query("f11_stratified_episodes", "episode_id:s class:i", "SELECT * FROM (SELECT *, md5(concat_ws('|', episode_id, 42)) AS h, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', episode_id, 42))) AS turn FROM episodes) ORDER BY turn, h LIMIT 12")
def _(t: Tables) -> DataFrame:
    return eda.stratified_sample(t.episodes, ["class"], 12)


@query("f13_evaluation_episodes", "episode_id:s", "SELECT * FROM episodes ORDER BY i_store, i_item, j_store, j_item, treat_start, episode_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return pr.subset(t.episodes, "first", 5)


# sources and sinks: written to the shared folder and read back
def _path(t: Tables, name: str) -> str:
    """A new path whose extension is kept."""
    stem, dot, kind = name.partition(".")
    return fresh_path(t.spark, stem) if not dot else f"{fresh_path(t.spark, stem)}/{stem}.{kind}"


@query("a15_csv_sink", "date:d store_nbr:i item_nbr:i unit_sales onpromotion:i", "SELECT * FROM panel")
def _(t: Tables) -> DataFrame:
    io.write_table(t.sales.select("date", "store_nbr", "item_nbr", "unit_sales", F.when(F.col("onpromotion") == 1, "True").otherwise("False").alias("onpromotion")), path := _path(t, "sales.csv"))
    return io.read_panel(t.spark, path)


@query("a9_store_shards", "store_nbr:i t:i item_nbr:i H_prop_raw", "SELECT * FROM exposure")
def _(t: Tables) -> DataFrame:
    io.write_by_store(t.exposed, path := _path(t, "exposure"))
    return t.spark.read.parquet(path)


@query("a16_exposure_sink", "store_nbr:i t:i item_nbr:i H_bin:i", "SELECT * FROM exposure")
def _(t: Tables) -> DataFrame:
    io.write_table(t.exposed, path := _path(t, "exposure.parquet"))
    return io.read_any(t.spark, path)


@query("a8_parquet_scan", "o_orderkey:i o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    return io.read_any(t.spark, f"{t.dir}/orders.parquet")


@query("a21_read_under_root", "r_regionkey:i r_name:s", "SELECT * FROM region")
def _(t: Tables) -> DataFrame:
    return io.read_under(t.spark, t.dir, "region.parquet")


@query("a13_metric_folder", "episode_id:s model_type:s att_mean", "SELECT episode_id, 'X' AS model_type, att_mean FROM att")
def _(t: Tables) -> DataFrame:
    from promolens.operators import metrics as mt

    io.write_table(mt.att(t.cf).drop("model_type"), path := _path(t, "metrics"))
    return io.read_metrics(t.spark, path, "X")


@query("a14_series_normaliser", "episode_id:s t:i y_obs mu0_hat effect", "SELECT episode_id, t, y_obs, mu0_hat, e AS effect FROM cfe")
def _(t: Tables) -> DataFrame:
    given = t.cf.select("episode_id", "t", F.col("y_obs").alias("obs"), F.col("mu0_hat").alias("y_hat"))
    return io.normalise_series(given.union(given))


@query("a17_series_sink", "episode_id:s model_type:s t:i y_obs", "SELECT * FROM cf")
def _(t: Tables) -> DataFrame:
    io.write_table(t.cf, path := _path(t, "series"), "model_type")
    return t.spark.read.parquet(path)


def _by_model(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """df, written in a folder per model and read back."""
    io.write_table(df, path := _path(t, name), "model_type")
    return t.spark.read.parquet(path)


@query("a17_panel_sink", "episode_id:s unit_id:s t:i unit_sales", "SELECT * FROM erows")
def _(t: Tables) -> DataFrame:
    io.write_table(t.rows, path := _path(t, "panels"))
    return t.spark.read.parquet(path)


@query("a17_observed_sink", "episode_id:s t:i unit_sales", "SELECT episode_id, t, unit_sales FROM erows WHERE is_victim = 1")
def _(t: Tables) -> DataFrame:
    io.write_table(t.rows.filter("is_victim = 1").select("episode_id", "t", "unit_sales"), path := _path(t, "observed"))
    return t.spark.read.parquet(path)


@query("a17_placebo_sink", "episode_id:s model_type:s unit_id:s att", "SELECT * FROM draws")
def _(t: Tables) -> DataFrame:
    return _by_model(t, t.draws, "placebos")


@query("a17_leave_one_out_sink", "episode_id:s model_type:s unit_id:s att", "SELECT * FROM loo_draws")
def _(t: Tables) -> DataFrame:
    return _by_model(t, t.loo_draws, "loo")


@query("a17_sensitivity_sink", "episode_id:s model_type:s spec_id:s att", "SELECT * FROM spec_draws")
def _(t: Tables) -> DataFrame:
    return _by_model(t, t.spec_draws, "sensitivity")


@query("a17_metrics_sink", "episode_id:s model_type:s att_mean p_value", "SELECT * FROM att LEFT JOIN placebos USING (episode_id, model_type)")
def _(t: Tables) -> DataFrame:
    from promolens.operators import metrics as mt

    return _by_model(t, mt.merge_latest(mt.att(t.cf), t.placebos.select("episode_id", "model_type", "p_value"), "p_value"), "causal_metrics")


@query("a18_stack_sinks", "episode_id:s unit_id:s t:i onpromotion:i", "SELECT * FROM erows")
def _(t: Tables) -> DataFrame:
    keys = ["episode_id", "unit_id", "t"]
    io.write_stack(t.rows, path := _path(t, "stack"), ["unit_sales"], keys)
    x, y = io.read_any(t.spark, f"{path}/x"), io.read_any(t.spark, f"{path}/y")
    return x.join(y, keys)


@query("a19_summary_sinks", "store_nbr:i n:i mean", "SELECT store_nbr, count(H_prop_raw) AS n, avg(H_prop_raw) AS mean FROM exposure GROUP BY 1")
def _(t: Tables) -> DataFrame:
    io.write_both({"by_store": ex.by_store(t.exposed)}, path := _path(t, "summary"))
    schema = T.StructType([T.StructField("store_nbr", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType())])
    return io.read_any(t.spark, f"{path}/by_store.csv", schema)


@query("a12_allow_list", "episode_id:s", "SELECT episode_id FROM episodes WHERE j_store % 2 = 0")
def _(t: Tables) -> DataFrame:
    io.write_table(t.episodes.filter("j_store % 2 = 0").select("episode_id"), path := _path(t, "allow.csv"))
    return pr.subset(t.episodes, "explicit", 0, allowed=io.read_any(t.spark, path))


@query("a2_required_columns", "date:d store_nbr:i item_nbr:i unit_sales onpromotion:i", "SELECT * FROM panel")
def _(t: Tables) -> DataFrame:
    """The panel under another name for its sales, brought back and checked."""
    named = rename_synonyms(t.sales.withColumnRenamed("unit_sales", "sales"), {"unit_sales": ("sales", "y")})
    return require_columns(named, ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"], "sales")


@query("a2_promo_synonyms", "date:d store_nbr:i item_nbr:i flag:i", "SELECT date, store_nbr, item_nbr, onpromotion AS flag FROM panel")
def _(t: Tables) -> DataFrame:
    return t.sales.withColumn("flag", promo_flag(F.col("onpromotion").cast("string")))


# streams: the same aggregates run on a stream; here on the whole table
@query("k1_windowed_totals", "start:s event_type:s n:i total", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ev.windowed_totals(t.raw("events"))


@query("k2_sessions", "user_id:i n:i sessions:i", """
  SELECT user_id, count(*) AS n, sum(new) AS sessions FROM (SELECT user_id, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT, 1) AS new FROM events) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return ev.sessions(t.raw("events")).groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))
