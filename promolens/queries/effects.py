"""Features, episode panels, estimators and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.operators import episodes as ep
from promolens.operators import features as ft
from promolens.operators import metrics as mt
from promolens.operators import runs as rn
from promolens.plans import gsc, meta, placebo
from promolens.queries.registry import CTES, query
from promolens.queries.selection import UNIT
from promolens.queries.tables import Tables

KEY = "date:d " + UNIT

CTES["weeks"] = "SELECT *, isoyear(date)::VARCHAR || '-' || lpad(week(date)::VARCHAR, 2, '0') AS year_week FROM transactions"
CTES["day_holidays"] = "SELECT * FROM holidays WHERE lower(type) <> 'transfer' AND type IN ('Holiday', 'Additional', 'Bridge')"


@query("d10_weekly_proxies", "year_week:s store_nbr:i F_state", "SELECT year_week, store_nbr, ln(1 + sum(transactions)) AS F_state FROM weeks GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ft.weekly_proxies(t.transactions(), t.oil())[0]


@query("d10_weekly_oil", "year_week:s O_week", "SELECT isoyear(date)::VARCHAR || '-' || lpad(week(date)::VARCHAR, 2, '0') AS year_week, avg(dcoilwtico) AS O_week FROM oil GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return ft.weekly_proxies(t.transactions(), t.oil())[1]


CTES["share"] = "SELECT year_week, store_nbr, own / sum(own) OVER (PARTITION BY year_week, state) AS R_share FROM (SELECT year_week, store_nbr, state, sum(transactions) AS own FROM weeks JOIN stores USING (store_nbr) GROUP BY ALL)"


@query("d11_regional_share", "year_week:s store_nbr:i R_share", "SELECT * FROM share")
def _(t: Tables) -> DataFrame:
    return ft.regional_share(t.transactions(), t.stores())


@query("d12_effective_holidays", "date:d type:s locale_name:s units:i", "SELECT h.date, type, locale_name, count(*) AS units FROM holidays h JOIN panel p ON p.date = h.date WHERE lower(type) <> 'transfer' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    cells = t.sales.groupBy("date").agg(F.count("*").alias("units"))
    return ft.effective_holidays(t.holidays()).join(cells, "date")


@query("c5_holiday_join", KEY + "HNat:i HReg:i HLoc:i is_bridge:i is_additional:i is_work_day:i", """
  SELECT p.date, store_nbr, item_nbr, (p.date IN (SELECT date FROM day_holidays WHERE locale = 'National'))::INT AS HNat,
         ((p.date, state) IN (SELECT (date, locale_name) FROM day_holidays WHERE locale = 'Regional'))::INT AS HReg, ((p.date, city) IN (SELECT (date, locale_name) FROM day_holidays WHERE locale = 'Local'))::INT AS HLoc,
         coalesce(b, 0) AS is_bridge, coalesce(a, 0) AS is_additional, coalesce(w, 0) AS is_work_day
  FROM panel p JOIN stores USING (store_nbr) LEFT JOIN (SELECT date, max((type = 'Bridge')::INT) AS b, max((type = 'Additional')::INT) AS a, max((type = 'Work Day')::INT) AS w FROM holidays WHERE lower(type) <> 'transfer' GROUP BY date) h ON h.date = p.date""")
def _(t: Tables) -> DataFrame:
    return ft.attach_holidays(t.sales, t.holidays(), t.stores())


@query("c6_weekly_joins", KEY + "F_state R_share", """
  SELECT date, store_nbr, item_nbr, F_state, R_share FROM (SELECT *, isoyear(date)::VARCHAR || '-' || lpad(week(date)::VARCHAR, 2, '0') AS year_week FROM panel)
  JOIN (SELECT year_week, store_nbr, ln(1 + sum(transactions)) AS F_state FROM weeks GROUP BY ALL) USING (year_week, store_nbr) JOIN share USING (year_week, store_nbr)""")
def _(t: Tables) -> DataFrame:
    return ft.attach_proxies(t.sales, t.transactions(), t.oil(), t.stores())


@query("e10_forward_fill", "year_week:s price", "SELECT year_week, coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY year_week ROWS UNBOUNDED PRECEDING), 0) AS price FROM (SELECT isoyear(date)::VARCHAR || '-' || lpad(week(date)::VARCHAR, 2, '0') AS year_week, avg(dcoilwtico) AS x FROM oil GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return ft.fill_forward(ft.weekly_proxies(t.transactions(), t.oil())[1], "O_week", "price", "year_week")


CTES["context"] = """
  SELECT *, avg(onpromotion) OVER g AS promo_share, CASE WHEN count(*) OVER g > 1 THEN (sum(onpromotion) OVER g - onpromotion) / (count(*) OVER g - 1)::DOUBLE ELSE 0 END AS promo_share_excl,
         greatest(sum(unit_sales) OVER g - unit_sales, 0) AS class_index_excl FROM panel WINDOW g AS (PARTITION BY store_nbr, class, t)"""


@query("d8_promo_pressure", "store_nbr:i class:i t:i n_items:i n_promo:i promo_share", "SELECT store_nbr, class, t, count(DISTINCT item_nbr) AS n_items, sum(onpromotion) AS n_promo, avg(onpromotion) AS promo_share FROM panel GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ft.promo_pressure(t.sales)


@query("c7_promo_context", KEY + "promo_share promo_share_excl", "SELECT * FROM context")
def _(t: Tables) -> DataFrame:
    return ft.promo_context(t.sales)


@query("d9_class_index", KEY + "class_index_excl", "SELECT * FROM context")
def _(t: Tables) -> DataFrame:
    return ft.class_index_without(t.sales)


@query("e13_context_lags", KEY + "promo_share_excl_l1 class_index_excl_l2", "SELECT *, lag(promo_share_excl) OVER u AS promo_share_excl_l1, lag(class_index_excl, 2) OVER u AS class_index_excl_l2 FROM context WINDOW u AS (PARTITION BY store_nbr, item_nbr ORDER BY t)")
def _(t: Tables) -> DataFrame:
    return ft.lagged(ft.class_index_without(ft.promo_context(t.sales)), ["promo_share_excl", "class_index_excl"], [1, 2])


@query("e9_sales_history", KEY + "unit_sales_l1 unit_sales_l6 roll_mean_7 roll_sd_7", """
  SELECT *, lag(unit_sales, 1) OVER u AS unit_sales_l1, lag(unit_sales, 6) OVER u AS unit_sales_l6, CASE WHEN count(*) OVER w >= 2 THEN avg(unit_sales) OVER w END AS roll_mean_7, CASE WHEN count(*) OVER w >= 2 THEN stddev_samp(unit_sales) OVER w END AS roll_sd_7
  FROM panel WINDOW u AS (PARTITION BY store_nbr, item_nbr ORDER BY t), w AS (PARTITION BY store_nbr, item_nbr ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def _(t: Tables) -> DataFrame:
    return ft.sales_history(t.sales, t.cfg.lags, (7,))


@query("e11_trend_availability", KEY + "trend_T available_A:i trend_T_l1", """
  SELECT *, (trend_T > 40)::INT AS available_A, lag(trend_T) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) AS trend_T_l1
  FROM (SELECT *, avg(unit_sales) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t ROWS 6 PRECEDING) AS trend_T FROM panel)""")
def _(t: Tables) -> DataFrame:
    return ft.trend_and_availability(t.sales, least=40)


@query("e12_store_trend", "store_nbr:i t:i Q_store_trend Q_store_trend_l1", """
  SELECT *, lag(Q_store_trend) OVER (PARTITION BY store_nbr ORDER BY t) AS Q_store_trend_l1 FROM (
  SELECT store_nbr, t, avg(s) OVER (PARTITION BY store_nbr ORDER BY t ROWS 6 PRECEDING) AS Q_store_trend FROM (SELECT store_nbr, t, sum(unit_sales) AS s FROM panel GROUP BY ALL))""")
def _(t: Tables) -> DataFrame:
    return ft.store_trend(t.sales)


@query("e14_zero_streak", KEY + "zero_streak:i", """
  SELECT *, CASE WHEN z = 1 THEN row_number() OVER (PARTITION BY store_nbr, item_nbr, z, island ORDER BY t) ELSE 0 END AS zero_streak FROM (
    SELECT *, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) - row_number() OVER (PARTITION BY store_nbr, item_nbr, z ORDER BY t) AS island FROM (SELECT *, (unit_sales - 20 <= 0)::INT AS z FROM panel))""")
def _(t: Tables) -> DataFrame:
    return rn.zero_streaks(t.sales.withColumn("unit_sales", F.col("unit_sales") - 20))


@query("d13_intermittency", UNIT + "ADI CV2", """
  SELECT store_nbr, item_nbr, (count(*) - sum((x > 0)::INT)) / (sum((x > 0)::INT) + 1)::DOUBLE AS ADI, CASE WHEN avg(x) > 0 THEN (stddev_pop(x) / (avg(x) + 1e-6)) ** 2 ELSE 0 END AS CV2
  FROM (SELECT *, greatest(unit_sales - 20, 0) AS x FROM panel) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return ft.intermittency(t.sales.withColumn("unit_sales", F.greatest(F.col("unit_sales") - 20, F.lit(0.0))))


@query("h16_dummies", "store_nbr:i type_B:i type_C:i type_D:i type_E:i", "SELECT store_nbr, " + ", ".join(f"(type = '{x}')::INT AS type_{x}" for x in "BCDE") + " FROM stores")
def _(t: Tables) -> DataFrame:
    return ft.dummies(t.stores(), "type", list("ABCDE"), "type")


@query("b15_feature_panel", KEY + "unit_sales onpromotion:i HNat:i F_state R_share promo_share_excl roll_mean_7 trend_T zero_streak:i ADI sin_1 is_month_start:i", """
  SELECT c.date, c.store_nbr, c.item_nbr, c.unit_sales, c.onpromotion, (c.date IN (SELECT date FROM day_holidays WHERE locale = 'National'))::INT AS HNat, F_state, R_share, promo_share_excl,
         CASE WHEN count(*) OVER w >= 2 THEN avg(c.unit_sales) OVER w END AS roll_mean_7, avg(c.unit_sales) OVER s AS trend_T, zero_streak,
         (count(*) OVER a - sum((c.unit_sales > 0)::INT) OVER a) / (sum((c.unit_sales > 0)::INT) OVER a + 1)::DOUBLE AS ADI,
         sin(0.01720242383895848 * dayofyear(c.date)) AS sin_1, (day(c.date) <= 3)::INT AS is_month_start
  FROM (SELECT *, isoyear(date)::VARCHAR || '-' || lpad(week(date)::VARCHAR, 2, '0') AS year_week FROM context) c
  LEFT JOIN (SELECT year_week, store_nbr, ln(1 + sum(transactions)) AS F_state FROM weeks GROUP BY ALL) f ON f.year_week = c.year_week AND f.store_nbr = c.store_nbr
  LEFT JOIN share h ON h.year_week = c.year_week AND h.store_nbr = c.store_nbr
  JOIN (SELECT store_nbr, item_nbr, t, CASE WHEN z = 1 THEN row_number() OVER (PARTITION BY store_nbr, item_nbr, z, island ORDER BY t) ELSE 0 END AS zero_streak FROM (
    SELECT *, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) - row_number() OVER (PARTITION BY store_nbr, item_nbr, z ORDER BY t) AS island FROM (SELECT *, (unit_sales <= 0)::INT AS z FROM panel))) z
  ON z.store_nbr = c.store_nbr AND z.item_nbr = c.item_nbr AND z.t = c.t
  WINDOW w AS (PARTITION BY c.store_nbr, c.item_nbr ORDER BY c.t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), s AS (PARTITION BY c.store_nbr, c.item_nbr ORDER BY c.t ROWS 6 PRECEDING), a AS (PARTITION BY c.store_nbr, c.item_nbr)""")
def _(t: Tables) -> DataFrame:
    return t.features


# episode panels
CTES["episode_units"] = """
  SELECT episode_id, pre_start, treat_start, post_end, j_store AS store_nbr, j_item AS item_nbr, 1 AS is_victim FROM episodes
  UNION ALL SELECT e.episode_id, e.pre_start, e.treat_start, e.post_end, d.store_nbr, d.item_nbr, 0 FROM donors d JOIN episodes e ON e.episode_id = d.episode_id WHERE d.store_nbr IS NOT NULL"""
CTES["erows"] = """
  SELECT u.episode_id, u.treat_start, u.is_victim, p.*, p.store_nbr || ':' || p.item_nbr AS unit_id, (p.t >= treat_start)::INT AS treated_time, (p.t < treat_start)::INT AS is_pre
  FROM episode_units u JOIN panel p ON p.store_nbr = u.store_nbr AND p.item_nbr = u.item_nbr AND p.t BETWEEN pre_start AND post_end"""
CTES["cf"] = """
  SELECT * FROM (SELECT episode_id, 'DONOR' AS model_type, t, treat_start, max(unit_sales) FILTER (is_victim = 1) AS y_obs, avg(unit_sales) FILTER (is_victim = 0) AS mu0_hat FROM erows GROUP BY episode_id, t, treat_start) WHERE y_obs IS NOT NULL AND mu0_hat IS NOT NULL"""
CTES["cfe"] = "SELECT *, y_obs - mu0_hat AS e, (t < treat_start) AS pre FROM cf"
CTES["dquality"] = "SELECT *, (is_victim = 1 OR (promo_share <= 0.2 AND avail_share >= 0.4))::INT AS keep FROM (SELECT episode_id, store_nbr, item_nbr, is_victim, avg(onpromotion) AS promo_share, avg((unit_sales > 40)::INT) AS avail_share FROM erows GROUP BY ALL)"
CTES["dreasons"] = "SELECT *, CASE WHEN is_victim = 1 THEN '' ELSE concat_ws('; ', CASE WHEN promo_share > 0.2 THEN 'promo_share' END, CASE WHEN avail_share < 0.4 THEN 'avail_share' END) END AS reason FROM dquality"


@query("c11_episode_panel", "episode_id:s " + UNIT + "t:i unit_sales is_victim:i", "SELECT * FROM erows")
def _(t: Tables) -> DataFrame:
    return t.rows


@query("g7_panel_stack", "episode_id:s " + UNIT + "t:i unit_sales is_victim:i", "SELECT * FROM erows WHERE is_victim = 0 UNION ALL SELECT * FROM erows WHERE is_victim = 1")
def _(t: Tables) -> DataFrame:
    """The victims' and the donors' panels under each other."""
    return t.rows.filter("is_victim = 1").unionByName(t.rows.filter("is_victim = 0"))


@query("b19_treatment_labels", "episode_id:s unit_id:s t:i treated_time:i D:i is_pre:i train_mask:i", "SELECT *, treated_time * is_victim AS D, 1 - treated_time * is_victim AS train_mask FROM erows")
def _(t: Tables) -> DataFrame:
    return t.rows


@query("d19_episode_weights", "episode_id:s unit_id:s t:i w_episode", "SELECT *, 1.0 / count(*) OVER (PARTITION BY episode_id) AS w_episode FROM erows")
def _(t: Tables) -> DataFrame:
    return t.rows


@query("d18_promo_availability", "episode_id:s " + UNIT + "promo_share avail_share", "SELECT * FROM dquality")
def _(t: Tables) -> DataFrame:
    return t.quality


@query("b13_donor_quality", "episode_id:s " + UNIT + "keep:i reason:s", "SELECT * FROM dreasons")
def _(t: Tables) -> DataFrame:
    return t.quality


@query("d45_discard_reasons", "reason:s n:i", "SELECT trim(r) AS reason, count(*) AS n FROM (SELECT unnest(string_split(reason, ';')) AS r FROM dreasons WHERE keep = 0) GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ep.discard_reasons(t.quality)


@query("d19_episode_counts", "episode_id:s n_rows:i n_donors_kept:i n_donors_input:i", """
  SELECT episode_id, count(*) AS n_rows, count(DISTINCT unit_id) FILTER (is_victim = 0) AS n_donors_kept, any_value(k) AS n_donors_input
  FROM erows LEFT JOIN (SELECT episode_id, count(*) AS k FROM donors WHERE store_nbr IS NOT NULL GROUP BY 1) USING (episode_id) GROUP BY episode_id""")
def _(t: Tables) -> DataFrame:
    return ep.episode_counts(t.rows, t.donors)


@query("b6_universe_window", UNIT + "t:i unit_sales", """
  SELECT store_nbr, item_nbr, t, unit_sales FROM panel WHERE (store_nbr, item_nbr) IN (SELECT (store_nbr, item_nbr) FROM episode_units) AND t BETWEEN (SELECT min(pre_start) FROM episodes) AND (SELECT max(post_end) FROM episodes)""")
def _(t: Tables) -> DataFrame:
    units = ep.episode_units(t.episodes, t.donors).select("store_nbr", "item_nbr").distinct()
    whole = t.episodes.agg(F.min("pre_start").alias("a"), F.max("post_end").alias("b")).withColumn("k", F.lit(1))
    return t.sales.join(units, ["store_nbr", "item_nbr"], "left_semi").withColumn("k", F.lit(1)).join(F.broadcast(whole), "k").filter("t BETWEEN a AND b")


@query("c21_victim_vs_donors", "episode_id:s t:i y_obs mu0_hat", "SELECT * FROM cf")
def _(t: Tables) -> DataFrame:
    return t.cf


CTES["gram"] = """
  SELECT a.episode_id, a.unit_id AS a, CASE WHEN b.is_victim = 0 THEN b.unit_id ELSE 'y' END AS b, sum(a.unit_sales * b.unit_sales) AS g
  FROM erows a JOIN erows b ON a.episode_id = b.episode_id AND a.t = b.t WHERE a.is_pre = 1 AND a.is_victim = 0 GROUP BY ALL"""


@query("j1_gram_matrix", "episode_id:s a:s b:s g", "SELECT * FROM gram")
def _(t: Tables) -> DataFrame:
    return ep.donor_gram(t.rows)


@query("j1_donor_blend", "episode_id:s t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    return ep.donor_blend(t.rows)


# metrics on the donor-mean series
SERIES = "episode_id:s model_type:s "
_g = "FROM cfe GROUP BY episode_id, model_type"


@query("d24_fit", SERIES + "rmspe_pre mae_pre corr_pre r2_pre", f"""
  SELECT episode_id, model_type, sqrt(avg(e * e) FILTER (pre)) / greatest(1, sqrt(avg(y_obs * y_obs) FILTER (pre))) AS rmspe_pre, avg(abs(e)) FILTER (pre) AS mae_pre,
         CASE WHEN stddev_pop(y_obs) FILTER (pre) > 1e-9 AND stddev_pop(mu0_hat) FILTER (pre) > 1e-9 THEN corr(y_obs, mu0_hat) FILTER (pre) END AS corr_pre,
         CASE WHEN sum(y_obs * y_obs) FILTER (pre) - count(y_obs) FILTER (pre) * (avg(y_obs) FILTER (pre)) ** 2 > 1e-9 THEN 1 - (sum(e * e) FILTER (pre)) / (sum(y_obs * y_obs) FILTER (pre) - count(y_obs) FILTER (pre) * (avg(y_obs) FILTER (pre)) ** 2) END AS r2_pre {_g}""")
def _(t: Tables) -> DataFrame:
    return mt.fit(t.cf)


@query("d25_fit_small_floor", SERIES + "rmspe_pre", f"SELECT episode_id, model_type, sqrt(avg(e * e) FILTER (pre)) / greatest(1e-8, sqrt(avg(y_obs * y_obs) FILTER (pre))) AS rmspe_pre {_g}")
def _(t: Tables) -> DataFrame:
    return mt.fit(t.cf, 1e-8)


CTES["att"] = f"SELECT episode_id, model_type, avg(e) FILTER (NOT pre) AS att_mean, sum(e) FILTER (NOT pre) AS att_sum, count(e) FILTER (NOT pre) AS n_post {_g}"


@query("d31_att", SERIES + "att_mean att_sum n_post:i", "SELECT * FROM att")
def _(t: Tables) -> DataFrame:
    return mt.att(t.cf)


@query("d26_heterogeneity", SERIES + "tau_mean tau_sd tau_cv tau_median tau_pos_share", f"""
  SELECT *, CASE WHEN abs(tau_mean) > 1e-8 THEN tau_sd / abs(tau_mean) END AS tau_cv FROM (SELECT episode_id, model_type, avg(e) FILTER (NOT pre) AS tau_mean, stddev_pop(e) FILTER (NOT pre) AS tau_sd,
  quantile_cont(e, 0.5) FILTER (NOT pre) AS tau_median, avg((e > 0)::INT) FILTER (NOT pre) AS tau_pos_share {_g})""")
def _(t: Tables) -> DataFrame:
    return mt.heterogeneity(t.cf)


@query("d60_variability", SERIES + "cv_obs_pre cv_cf_pre cv_obs_post cv_cf_post", "SELECT episode_id, model_type, " + ", ".join(
    f"stddev_pop({c}) FILTER ({f}) / (avg(abs({c})) FILTER ({f}) + 1e-8) AS cv_{n}_{p}" for p, f in (("pre", "pre"), ("post", "NOT pre")) for c, n in (("y_obs", "obs"), ("mu0_hat", "cf"))) + f" {_g}")
def _(t: Tables) -> DataFrame:
    return mt.variability(t.cf)


CTES["hor"] = "SELECT episode_id, model_type, " + ", ".join(f"coalesce(sum(e) FILTER (NOT pre AND t < treat_start + {k}), 0) AS att_{k}" for k in (2, 4, 6)) + f" {_g}"


@query("d32_horizons", SERIES + "att_2 att_4 att_6 att_sd att_range", "SELECT *, sqrt(((att_2 - m) ** 2 + (att_4 - m) ** 2 + (att_6 - m) ** 2) / 3) AS att_sd, greatest(att_2, att_4, att_6) - least(att_2, att_4, att_6) AS att_range FROM (SELECT *, (att_2 + att_4 + att_6) / 3 AS m FROM hor)")
def _(t: Tables) -> DataFrame:
    return mt.horizons(t.cf, (2, 4, 6))


@query("e16_cumulative_effect", SERIES + "t:i effect cum_effect", "SELECT *, e AS effect, sum(CASE WHEN pre THEN 0 ELSE e END) OVER (PARTITION BY episode_id, model_type ORDER BY t) AS cum_effect FROM cfe")
def _(t: Tables) -> DataFrame:
    return mt.with_effect(t.cf)


@query("d44_naive_did", SERIES + "did rmspe_pct", f"SELECT episode_id, model_type, avg(e) FILTER (NOT pre) - avg(e) FILTER (pre) AS did, CASE WHEN avg(y_obs) FILTER (pre) > 1e-9 THEN 100 * sqrt(avg(e * e) FILTER (pre)) / avg(y_obs) FILTER (pre) END AS rmspe_pct {_g}")
def _(t: Tables) -> DataFrame:
    return mt.naive_did(t.cf)


@query("j23_ols_calibration", SERIES + "t:i mu0_hat", """
  SELECT episode_id, model_type, t, CASE WHEN n >= 5 AND v > 1e-9 THEN my + c / v * (mu0_hat - mx) ELSE mu0_hat END AS mu0_hat FROM cf JOIN (
    SELECT episode_id, model_type, count(*) AS n, covar_pop(y_obs, mu0_hat) AS c, var_pop(mu0_hat) AS v, avg(mu0_hat) AS mx, avg(y_obs) AS my FROM cfe WHERE pre GROUP BY ALL) USING (episode_id, model_type)""")
def _(t: Tables) -> DataFrame:
    return mt.ols_calibration(t.cf)


@query("e17_level_calibration", SERIES + "t:i mu0_hat", """
  SELECT c.episode_id, c.model_type, t, mu0_hat + coalesce(level, 0) AS mu0_hat FROM cf c LEFT JOIN (SELECT episode_id, model_type, avg(e) AS level FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, model_type ORDER BY t DESC) AS k FROM cfe WHERE pre) WHERE k <= 6 GROUP BY ALL) l
  ON l.episode_id = c.episode_id AND l.model_type = c.model_type""")
def _(t: Tables) -> DataFrame:
    return mt.level_calibration(t.cf, 6)


@query("e18_smoothing", SERIES + "t:i mu0_hat", "SELECT episode_id, model_type, t, sum(mu0_hat) OVER (PARTITION BY episode_id, model_type ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS mu0_hat FROM cf")
def _(t: Tables) -> DataFrame:
    return mt.smooth(t.cf)


_smd = """
  SELECT episode_id, covariate, CASE WHEN var > 1e-12 THEN (m1 - m0) / sqrt(var) END AS smd FROM (SELECT *, {var} AS var FROM (
    SELECT episode_id, covariate, count(x) FILTER (is_victim = 1) AS n1, count(x) FILTER (is_victim = 0) AS n0, avg(x) FILTER (is_victim = 1) AS m1, avg(x) FILTER (is_victim = 0) AS m0,
           var_samp(x) FILTER (is_victim = 1) AS v1, var_samp(x) FILTER (is_victim = 0) AS v0
    FROM (SELECT episode_id, is_victim, 'unit_sales' AS covariate, unit_sales AS x FROM erows UNION ALL SELECT episode_id, is_victim, 'onpromotion', onpromotion FROM erows) GROUP BY ALL))"""
CTES["smd"] = _smd.format(var="((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)")


@query("d22_balance", "episode_id:s covariate:s smd", "SELECT * FROM smd")
def _(t: Tables) -> DataFrame:
    return t.smd


@query("d22_balance_summary", "episode_id:s mean_abs_smd max_abs_smd n_over:i balance_rate", "SELECT episode_id, avg(abs(smd)) AS mean_abs_smd, max(abs(smd)) AS max_abs_smd, sum((abs(smd) > 0.25)::INT) AS n_over, avg((abs(smd) <= 0.25)::INT) AS balance_rate FROM smd GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mt.balance_summary(t.smd)


@query("d23_balance_mean_pooled", "episode_id:s covariate:s smd", _smd.format(var="(v1 + v0) / 2"))
def _(t: Tables) -> DataFrame:
    return mt.balance(t.rows, ["unit_sales", "onpromotion"], pooled="mean")


# placebo and sensitivity tables: each donor in the victim's place against the other donors' mean
CTES["others"] = """
  SELECT episode_id, unit_id, t, treat_start, unit_sales AS y_obs, (sum(unit_sales) OVER g - unit_sales) / nullif(count(*) OVER g - 1, 0) AS mu0_hat
  FROM erows WHERE is_victim = 0 WINDOW g AS (PARTITION BY episode_id, t)"""
CTES["draws"] = "SELECT episode_id, 'DONOR' AS model_type, unit_id, avg(y_obs - mu0_hat) AS att FROM others WHERE t >= treat_start AND mu0_hat IS NOT NULL GROUP BY ALL"
CTES["placebos"] = """
  SELECT episode_id, model_type, count(att) AS n, avg(att) AS mean, stddev_pop(att) AS sd, quantile_cont(att, 0.05) AS q05, quantile_cont(att, 0.5) AS q50, quantile_cont(att, 0.95) AS q95, avg(abs(att)) AS mean_abs,
         quantile_cont(abs(att), 0.95) AS q95_abs, (1 + sum((abs(att) >= abs(att_mean) - 1e-9)::INT)) / (1 + count(att))::DOUBLE AS p_value, CASE WHEN avg(abs(att)) > 1e-8 THEN abs(any_value(att_mean)) / avg(abs(att)) END AS effect_ratio
  FROM draws JOIN att USING (episode_id, model_type) GROUP BY ALL"""


@query("c20_placebo_rows", "episode_id:s unit_id:s att", "SELECT * FROM draws")
def _(t: Tables) -> DataFrame:
    return t.draws


@query("d28_placebo", SERIES + "n:i mean sd q05 q50 q95 mean_abs q95_abs p_value effect_ratio", "SELECT * FROM placebos")
def _(t: Tables) -> DataFrame:
    return t.placebos


CTES["loo_draws"] = """
  SELECT d.episode_id, 'DONOR' AS model_type, unit_id, avg(cf.y_obs - d.mu0_hat) AS att FROM others d JOIN cf ON cf.episode_id = d.episode_id AND cf.t = d.t
  WHERE d.t >= d.treat_start AND d.mu0_hat IS NOT NULL GROUP BY ALL"""
CTES["level_cf"] = """
  SELECT c.episode_id, c.model_type, t, treat_start, y_obs, mu0_hat + coalesce(level, 0) AS mu0_hat FROM cf c LEFT JOIN (
    SELECT episode_id, model_type, avg(e) AS level FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, model_type ORDER BY t DESC) AS k FROM cfe WHERE pre) WHERE k <= 6 GROUP BY ALL) l
  ON l.episode_id = c.episode_id AND l.model_type = c.model_type"""
CTES["ols_cf"] = """
  SELECT episode_id, model_type, t, treat_start, y_obs, CASE WHEN n >= 5 AND v > 1e-9 THEN my + c / v * (mu0_hat - mx) ELSE mu0_hat END AS mu0_hat FROM cf JOIN (
    SELECT episode_id, model_type, count(*) AS n, covar_pop(y_obs, mu0_hat) AS c, var_pop(mu0_hat) AS v, avg(mu0_hat) AS mx, avg(y_obs) AS my FROM cfe WHERE pre GROUP BY ALL) USING (episode_id, model_type)"""
CTES["smooth_cf"] = "SELECT episode_id, model_type, t, treat_start, y_obs, sum(mu0_hat) OVER (PARTITION BY episode_id, model_type ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS mu0_hat FROM cf"
CTES["spec_draws"] = " UNION ALL ".join(f"SELECT episode_id, model_type, '{n}' AS spec_id, avg(y_obs - mu0_hat) AS att FROM {c} WHERE t >= treat_start GROUP BY ALL" for n, c in (("plain", "cf"), ("level", "level_cf"), ("ols", "ols_cf"), ("smooth", "smooth_cf")))
_flip = "least(avg((att > 0)::INT), avg((att < 0)::INT)) AS sign_flip_rate"
CTES["sens"] = f"""
  SELECT episode_id, model_type, count(att) AS n, avg(att) AS mean, stddev_pop(att) AS sd, CASE WHEN abs(avg(att)) > 1e-8 THEN stddev_pop(att) / abs(avg(att)) END AS cv, max(att) - min(att) AS range, {_flip},
         quantile_cont(att, 0.05) AS q05, quantile_cont(att, 0.5) AS q50, CASE WHEN abs(quantile_cont(att, 0.5)) > 1e-8 THEN (quantile_cont(att, 0.75) - quantile_cont(att, 0.25)) / abs(quantile_cont(att, 0.5)) END AS robust_ratio
  FROM spec_draws GROUP BY ALL"""


@query("d27_sensitivity", SERIES + "n:i mean sd cv range sign_flip_rate q05 q50 robust_ratio", "SELECT * FROM sens")
def _(t: Tables) -> DataFrame:
    return mt.sensitivity(t.spec_draws)


@query("d27_gsc_sensitivity", SERIES + "n:i mean sd cv range sign_flip_rate")
def _(t: Tables) -> DataFrame:
    return mt.sensitivity(t.gsc_draws)


@query("d29_leave_one_out", SERIES + "n:i sd min max range sign_flip_rate", f"SELECT episode_id, model_type, count(att) AS n, stddev_samp(att) AS sd, min(att) AS min, max(att) AS max, max(att) - min(att) AS range, {_flip} FROM loo_draws GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return mt.leave_one_out(t.loo_draws)


@query("d29_gsc_leave_one_out", SERIES + "n:i sd min max range sign_flip_rate")
def _(t: Tables) -> DataFrame:
    return mt.leave_one_out(t.gsc_loo)


@query("d58_significance", "model_type:s significant median_p", "SELECT model_type, avg((p_value < 0.2)::INT) AS significant, quantile_cont(p_value, 0.5) AS median_p FROM placebos GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mt.significance(t.placebos, 0.2)


@query("d50_placebo_noise", "model_type:s mean_abs median_q95 n:i", "SELECT model_type, avg(mean_abs) AS mean_abs, quantile_cont(q95_abs, 0.5) AS median_q95, count(*) AS n FROM placebos GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mt.placebo_noise(t.placebos)


@query("e19_ecdf", SERIES + "p_value ecdf", "SELECT episode_id, model_type, p_value, cume_dist() OVER (PARTITION BY model_type ORDER BY round(p_value, 9)) AS ecdf FROM placebos")
def _(t: Tables) -> DataFrame:
    return mt.ecdf(t.placebos.withColumn("p_value", F.round("p_value", 9)))


@query("f14_top_by_effect", SERIES + "att_mean rank:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY abs(att_mean) DESC, episode_id) AS rank FROM att) WHERE rank <= 25")
def _(t: Tables) -> DataFrame:
    return mt.top_by_abs(mt.att(t.cf), "att_mean", 25)


CTES["att2"] = "SELECT * FROM att UNION ALL SELECT episode_id, 'OLS', avg(y_obs - mu0_hat), sum(y_obs - mu0_hat), count(*) FROM ols_cf WHERE t >= treat_start GROUP BY episode_id HAVING count(*) > 5"


@query("d30_summary_by_model", "model_type:s att_mean_median att_mean_mean att_mean_sd att_mean_n:i", "SELECT model_type, quantile_cont(att_mean, 0.5) AS att_mean_median, avg(att_mean) AS att_mean_mean, stddev_samp(att_mean) AS att_mean_sd, count(att_mean) AS att_mean_n FROM att2 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mt.summary_by_model(t.two_models, ["att_mean"])


@query("g3_stacked_metrics", SERIES + "att_mean n_post:i", "SELECT * FROM att2")
def _(t: Tables) -> DataFrame:
    return t.two_models


@query("d54_comparison", SERIES + "att_sum", "SELECT * FROM att2")
def _(t: Tables) -> DataFrame:
    return t.two_models


@query("d56_coverage", "model_type:s expected:i available:i missing:i", "SELECT model_type, (SELECT count(DISTINCT episode_id) FROM episodes) AS expected, count(DISTINCT episode_id) AS available, (SELECT count(DISTINCT episode_id) FROM episodes) - count(DISTINCT episode_id) AS missing FROM att2 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mt.coverage(t.episodes, t.two_models)


@query("g4_missing_episodes", "episode_id:s", "SELECT episode_id FROM episodes EXCEPT SELECT episode_id FROM att2 WHERE model_type = 'OLS'")
def _(t: Tables) -> DataFrame:
    return mt.missing_episodes(t.episodes, t.two_models.filter("model_type = 'OLS'"))


@query("g5_computed_episodes", "episode_id:s", "SELECT DISTINCT episode_id FROM att2")
def _(t: Tables) -> DataFrame:
    return t.two_models.select("episode_id").distinct()


@query("c17_coverage_flags", "episode_id:s donor:i ols:i any:i", "SELECT episode_id, (episode_id IN (SELECT episode_id FROM att))::INT AS donor, (episode_id IN (SELECT episode_id FROM att2 WHERE model_type = 'OLS'))::INT AS ols, (episode_id IN (SELECT episode_id FROM att))::INT AS \"any\" FROM (SELECT DISTINCT episode_id FROM episodes)")
def _(t: Tables) -> DataFrame:
    return mt.coverage_flags(t.episodes, {"donor": mt.att(t.cf), "ols": t.two_models.filter("model_type = 'OLS'")})


@query("c16_merge_metrics", SERIES + "att_mean p_value", "SELECT * FROM att LEFT JOIN placebos USING (episode_id, model_type)")
def _(t: Tables) -> DataFrame:
    return mt.merge_latest(mt.att(t.cf), t.placebos.select("episode_id", "model_type", "p_value"), "p_value")


@query("d55_artefact_counts", "model_type:s fits:i placebos:i", "SELECT model_type, count(*) AS fits, count(p_value) AS placebos FROM att LEFT JOIN placebos USING (episode_id, model_type) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    joined = mt.att(t.cf).join(t.placebos.select("episode_id", "model_type", "p_value"), ["episode_id", "model_type"], "left")
    return joined.groupBy("model_type").agg(F.count("*").alias("fits"), F.count("p_value").alias("placebos"))


@query("d59_placebo_counts", "model_type:s n:i", "SELECT model_type, count(DISTINCT episode_id) AS n FROM draws GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.draws.groupBy("model_type").agg(F.countDistinct("episode_id").alias("n"))


@query("c24_episode_series", "episode_id:s t:i y_obs pre_start:i", "SELECT c.episode_id, c.t, c.y_obs, e.pre_start FROM cf c JOIN episodes e ON e.episode_id = c.episode_id")
def _(t: Tables) -> DataFrame:
    return t.cf.join(t.episodes.select("episode_id", "pre_start"), "episode_id")


CTES["fit"] = f"""
  SELECT episode_id, model_type, sqrt(avg(e * e) FILTER (pre)) / greatest(1, sqrt(avg(y_obs * y_obs) FILTER (pre))) AS rmspe_pre, stddev_pop(y_obs) FILTER (pre) / (avg(abs(y_obs)) FILTER (pre) + 1e-8) AS cv_obs_pre,
         stddev_pop(e) FILTER (NOT pre) AS tau_sd, CASE WHEN abs(avg(e) FILTER (NOT pre)) > 1e-8 THEN stddev_pop(e) FILTER (NOT pre) / abs(avg(e) FILTER (NOT pre)) END AS tau_cv {_g}"""
CTES["report"] = """
  SELECT f.*, a.att_mean, a.n_post, p.p_value, p.n AS n_placebo, s.cv AS sens_rel_sd, s.sign_flip_rate AS sens_flip_rate, b.mean_abs_smd
  FROM fit f JOIN att a ON a.episode_id = f.episode_id AND a.model_type = f.model_type LEFT JOIN placebos p ON p.episode_id = f.episode_id AND p.model_type = f.model_type
  LEFT JOIN sens s ON s.episode_id = f.episode_id AND s.model_type = f.model_type LEFT JOIN (SELECT episode_id, avg(abs(smd)) AS mean_abs_smd FROM smd GROUP BY 1) b ON b.episode_id = f.episode_id"""
REPORT = SERIES + "rmspe_pre att_mean tau_sd cv_obs_pre p_value n_placebo:i sens_rel_sd sens_flip_rate mean_abs_smd"


def _report(t: Tables) -> DataFrame:
    return mt.report(t.cf, t.rows, ["unit_sales", "onpromotion"], t.draws, t.spec_draws)


@query("j28_report", REPORT, "SELECT * FROM report")
def _(t: Tables) -> DataFrame:
    return _report(t)


@query("j28_gsc_report", REPORT)
def _(t: Tables) -> DataFrame:
    return mt.report(t.gsc_cf, t.rows, ["unit_sales", "onpromotion"], t.gsc_placebos, t.gsc_draws)


@query("d57_radar", "model_type:s fit stability heterogeneity balance significance", """
  SELECT model_type, greatest(least(1 - quantile_cont(rmspe_pre, 0.5), 1), 0) AS fit, 1 / (1 + quantile_cont(sens_rel_sd, 0.5)) AS stability, greatest(least(quantile_cont(tau_cv, 0.5) / 2, 1), 0) AS heterogeneity,
         greatest(least(1 - quantile_cont(mean_abs_smd, 0.5) / 0.5, 1), 0) AS balance, quantile_cont(p_value, 0.5) AS significance FROM report GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return mt.radar(_report(t))


@query("a20_json_report", "value:s", """
  SELECT json_object('episode_id', episode_id, 'model_type', model_type, 'att_mean', printf('%.4f', round(att_mean + 1e-9, 4)), 'n_post', n_post)::VARCHAR AS value FROM att WHERE n_post > 0""")
def _(t: Tables) -> DataFrame:
    from promolens.sources.io import report_json

    mean = F.format_string("%.4f", F.round(F.col("att_mean") + 1e-9, 4))
    return report_json(mt.att(t.cf).filter("n_post > 0").select("episode_id", "model_type", mean.alias("att_mean"), "n_post"))


@query("j29_robustness", SERIES + "n:i sign_flip_rate p_value", f"SELECT * FROM (SELECT episode_id, model_type, count(att) AS n, {_flip} FROM loo_draws GROUP BY ALL) JOIN (SELECT episode_id, model_type, p_value FROM placebos) USING (episode_id, model_type)")
def _(t: Tables) -> DataFrame:
    return mt.leave_one_out(t.loo_draws).join(t.placebos.select("episode_id", "model_type", "p_value"), ["episode_id", "model_type"])


@query("j30_consolidated", "model_type:s att_mean_median p_value_median", "SELECT model_type, quantile_cont(att_mean, 0.5) AS att_mean_median, quantile_cont(p_value, 0.5) AS p_value_median FROM att LEFT JOIN placebos USING (episode_id, model_type) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return mt.summary_by_model(mt.merge_latest(mt.att(t.cf), t.placebos.select("episode_id", "model_type", "p_value"), "p_value"), ["att_mean", "p_value"])


@query("j31_diagnostics", SERIES + "att_mean att_2 tau_sd", "SELECT * FROM att JOIN hor USING (episode_id, model_type) JOIN (SELECT episode_id, model_type, stddev_pop(e) FILTER (NOT pre) AS tau_sd FROM cfe GROUP BY ALL) USING (episode_id, model_type)")
def _(t: Tables) -> DataFrame:
    key = ["episode_id", "model_type"]
    return mt.att(t.cf).join(mt.horizons(t.cf, (2, 4, 6)), key).join(mt.heterogeneity(t.cf), key)


# estimators
CTES["changes"] = """
  SELECT * FROM (SELECT episode_id, unit_id, is_victim, avg(unit_sales) FILTER (is_pre = 0) - avg(unit_sales) FILTER (is_pre = 1) AS change FROM erows GROUP BY ALL) WHERE change IS NOT NULL"""
CTES["fake"] = """
  SELECT episode_id, draw, avg(change) FILTER (k = 1) - avg(change) FILTER (k > 1) AS x FROM (
    SELECT *, row_number() OVER (PARTITION BY episode_id, draw ORDER BY md5(concat_ws('|', episode_id, draw, unit_id, 42))) AS k FROM (SELECT *, unnest(range(0, 200)) AS draw FROM changes)) GROUP BY ALL"""


@query("j26_assignment_test", "episode_id:s att n:i p_value q05 q50 q95", """
  SELECT f.episode_id, any_value(att) AS att, count(*) AS n, (1 + sum((abs(x) >= abs(att) - 1e-9)::INT)) / (1 + count(*))::DOUBLE AS p_value, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.95) AS q95
  FROM fake f JOIN (SELECT episode_id, avg(change) FILTER (is_victim = 1) - avg(change) FILTER (is_victim = 0) AS att FROM changes GROUP BY 1) a ON a.episode_id = f.episode_id WHERE x IS NOT NULL GROUP BY f.episode_id""")
def _(t: Tables) -> DataFrame:
    return placebo.assignment_test(t.rows)


@query("b20_treatment_periods", "episode_id:s pre_first:i pre_last:i post_first:i post_last:i", "SELECT episode_id, min(t) FILTER (is_pre = 1) AS pre_first, max(t) FILTER (is_pre = 1) AS pre_last, min(t) FILTER (is_pre = 0) AS post_first, max(t) FILTER (is_pre = 0) AS post_last FROM erows GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return placebo.periods(t.rows)


@query("b21_treatment_columns", "episode_id:s unit_id:s t:i D_cont D_bin:i", "SELECT episode_id, unit_id, t, treated_time * is_victim AS D_cont, treated_time * is_victim AS D_bin FROM erows")
def _(t: Tables) -> DataFrame:
    return meta.treatment(t.rows, "H_disc")


@query("d20_unit_stats", UNIT + "u_mean u_sd u_slope u_last7 u_n:i", """
  SELECT store_nbr, item_nbr, avg(unit_sales) AS u_mean, stddev_pop(unit_sales) AS u_sd, covar_pop(unit_sales, t) / (var_pop(t) + 1e-8) AS u_slope, avg(unit_sales) FILTER (k <= 7) AS u_last7, count(*) AS u_n
  FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY t DESC) AS k FROM panel) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return meta.unit_stats(t.sales)


@query("c22_mapped_stats", KEY + "u_mean", """
  SELECT p.*, coalesce(m, g) AS u_mean FROM panel p LEFT JOIN (SELECT store_nbr, item_nbr, avg(unit_sales) AS m FROM panel WHERE t < 72 GROUP BY ALL) s ON s.store_nbr = p.store_nbr AND s.item_nbr = p.item_nbr,
  (SELECT avg(m) AS g FROM (SELECT avg(unit_sales) AS m FROM panel WHERE t < 72 GROUP BY store_nbr, item_nbr))""")
def _(t: Tables) -> DataFrame:
    return meta.map_stats(t.sales, meta.unit_stats(t.sales.filter("t < 72")), ["u_mean"])


@query("d21_sample_weights", KEY + "w", "SELECT *, v / avg(v) OVER () AS w FROM (SELECT *, exp(-0.01 * (max(t) OVER () - t)) / count(*) OVER (PARTITION BY store_nbr, item_nbr) AS v FROM panel)")
def _(t: Tables) -> DataFrame:
    return meta.sample_weights(t.sales, 0.01)


@query("j15_time_folds", "t:i fold:i train_before:i", "SELECT t, fold, min(t) OVER (PARTITION BY fold) - 1 AS train_before FROM (SELECT t, 2 - (k - 1) // 6 AS fold FROM (SELECT t, row_number() OVER (ORDER BY t DESC) AS k FROM (SELECT DISTINCT t FROM panel)) WHERE k <= 18)")
def _(t: Tables) -> DataFrame:
    return meta.time_folds(t.sales, 6, 3)


@query("j25_placebo_time", SERIES + "att", "SELECT episode_id, model_type, avg(e) FILTER (k <= 3) AS att FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, model_type ORDER BY t DESC) AS k FROM cfe WHERE pre) GROUP BY ALL HAVING count(*) >= 3")
def _(t: Tables) -> DataFrame:
    return meta.placebo_time(t.cf, 3)


CTES["folds"] = """
  SELECT DISTINCT episode_id, 'f' || h AS fold_id, h - 1 AS gap_from, h AS hide_from, h + 2 AS hide_to FROM (
    SELECT episode_id, a, unnest(list_append(CASE WHEN span >= 0 THEN list_transform(range(0, 3), lambda i: least(a + 4 + i * greatest(span // 3, 1), b - 2)) ELSE [b - 2] END, b - 2)) AS h
    FROM (SELECT episode_id, min(t) AS a, max(t) AS b, max(t) - min(t) + 1 - 7 AS span FROM erows WHERE is_victim = 1 AND is_pre = 1 GROUP BY 1)) WHERE h - 1 - a >= 1"""


@query("j6_rolling_folds", "episode_id:s fold_id:s gap_from:i hide_from:i hide_to:i", "SELECT * FROM folds")
def _(t: Tables) -> DataFrame:
    return gsc.folds(t.rows)


_masked = "SELECT r.episode_id, fold_id, unit_id, t, (NOT (t BETWEEN gap_from AND hide_to AND {rows}) AND NOT (is_victim = 1 AND t >= treat_start))::INT AS train_mask FROM erows r JOIN folds f ON f.episode_id = r.episode_id"


@query("j7_holdout_mask", "episode_id:s fold_id:s unit_id:s t:i train_mask:i", _masked.format(rows="is_victim = 1"))
def _(t: Tables) -> DataFrame:
    return gsc.holdout_mask(t.rows, gsc.folds(t.rows))


@query("j7_holdout_mask_all_rows", "episode_id:s fold_id:s unit_id:s t:i train_mask:i", _masked.format(rows="true"))
def _(t: Tables) -> DataFrame:
    return gsc.holdout_mask(t.rows, gsc.folds(t.rows), all_rows=True)


@query("j5_scales", "episode_id:s scale")
def _(t: Tables) -> DataFrame:
    return gsc.scales(t.rows)


@query("f17_prune_spiky", "episode_id:s unit_id:s t:i", """
  SELECT r.episode_id, r.unit_id, r.t FROM erows r LEFT JOIN (
    SELECT d.episode_id, d.unit_id, q <= 1.2 * vq OR row_number() OVER (PARTITION BY d.episode_id ORDER BY (q > 1.2 * vq)::INT, abs(m - vm), d.unit_id) <= 4 AS good
    FROM (SELECT episode_id, unit_id, quantile_cont(unit_sales, 0.95) AS q, avg(unit_sales) AS m FROM erows WHERE is_pre = 1 AND is_victim = 0 GROUP BY ALL) d
    JOIN (SELECT episode_id, quantile_cont(unit_sales, 0.95) AS vq, avg(unit_sales) AS vm FROM erows WHERE is_pre = 1 AND is_victim = 1 GROUP BY ALL) v ON v.episode_id = d.episode_id) g
  ON g.episode_id = r.episode_id AND g.unit_id = r.unit_id WHERE r.is_victim = 1 OR g.good""")
def _(t: Tables) -> DataFrame:
    return gsc.prune_spiky(t.rows, 1.2, 4)


@query("j4_gsc_counterfactual", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    return gsc.as_series(gsc.counterfactual(t.rows, gsc.grid(t.rows, (2,), (0.1,))))


@query("j2_two_stage_fit", SERIES + "t:i mu0_hat")
def _(t: Tables) -> DataFrame:
    """With growing penalties, without covariates: the low-rank steps alone."""
    specs = gsc.grid(t.rows, (2,), (0.1,)).withColumns({"covariates": F.lit(False), "growth": F.lit(1.2), "cap": F.lit(2.0), "inner": F.lit(60)})
    return gsc.as_series(gsc.counterfactual(t.rows, specs))


@query("j8_grid_selection", "episode_id:s spec_id:s score")
def _(t: Tables) -> DataFrame:
    return t.best_spec


@query("j9_random_search", "episode_id:s spec_id:s score")
def _(t: Tables) -> DataFrame:
    """By rungs: each fold keeps a quarter of the draws."""
    draws = gsc.random_specs(t.rows, 32, tau=(0.02, 0.25), alpha=(1e-4, 0.2), schedule=True)
    return gsc.select_spec(t.rows, draws, gsc.folds(t.rows), penalties=True, keep=0.25)


@query("j10_placebo_space", "episode_id:s job_id:s att")
def _(t: Tables) -> DataFrame:
    return t.gsc_placebos


@query("j11_placebo_time", "episode_id:s job_id:s att")
def _(t: Tables) -> DataFrame:
    return gsc.effects(gsc.placebo_time(t.rows, t.best_spec))


@query("j12_leave_one_out", "episode_id:s job_id:s att")
def _(t: Tables) -> DataFrame:
    return t.gsc_loo


@query("j13_global_sensitivity", "episode_id:s job_id:s att")
def _(t: Tables) -> DataFrame:
    return t.gsc_draws


@query("j14_final_gsc", SERIES + "rmspe_pre att_mean")
def _(t: Tables) -> DataFrame:
    rows = gsc.prune_spiky(t.rows)
    cf = gsc.final_run(rows, t.best_spec, gsc.folds(rows), embargo=1, bags=2, calibrate_last=6, smooth_half=1)
    return mt.fit(cf).join(mt.att(cf), ["episode_id", "model_type"])


@query("j27_grid_sensitivity", "episode_id:s job_id:s rmse_pre att")
def _(t: Tables) -> DataFrame:
    return placebo.best_of_grid(gsc.counterfactual(t.rows, gsc.grid(t.rows)).filter("y_obs IS NOT NULL"))


CTES["cells"] = "SELECT episode_id, t, e AS effect FROM cfe WHERE NOT pre"


@query("d51_effect_correlation", "n:i corr", "SELECT count(*) AS n, corr(a.effect, b.effect) AS corr FROM cells a JOIN (SELECT episode_id, t, y_obs - mu0_hat AS effect FROM ols_cf) b ON a.episode_id = b.episode_id AND a.t = b.t")
def _(t: Tables) -> DataFrame:
    return placebo.effect_correlation(t.cells, mt.ols_calibration(t.cf).select("episode_id", "t", (F.col("y_obs") - F.col("mu0_hat")).alias("effect")))


@query("g6_common_cells", "episode_id:s t:i", "SELECT episode_id, t FROM cells INTERSECT SELECT episode_id, t FROM others WHERE mu0_hat IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """Cells of the victims' effects that leave-one-out means have too."""
    w = Window.partitionBy("episode_id", "t")
    others = t.rows.filter("is_victim = 0").withColumn("n", F.count(F.lit(1)).over(w)).filter("n > 1")
    return t.cells.select("episode_id", "t").intersect(others.select("episode_id", "t"))


@query("d53_heterogeneity_summary", "tau_mean tau_sd q25 q50 q75 iqr att_i_mean att_i_sd att_t_mean att_t_sd", """
  SELECT *, q75 - q25 AS iqr FROM (SELECT avg(effect) AS tau_mean, stddev_samp(effect) AS tau_sd, quantile_cont(effect, 0.25) AS q25, quantile_cont(effect, 0.5) AS q50, quantile_cont(effect, 0.75) AS q75 FROM cells),
  (SELECT avg(a) AS att_i_mean, stddev_samp(a) AS att_i_sd FROM (SELECT avg(effect) AS a FROM cells GROUP BY episode_id)), (SELECT avg(a) AS att_t_mean, stddev_samp(a) AS att_t_sd FROM (SELECT avg(effect) AS a FROM cells GROUP BY t))""")
def _(t: Tables) -> DataFrame:
    return placebo.heterogeneity_summary(t.cells)


@query("d52_subgroup_effects", "bin:i n:i mean sd", "SELECT bin, count(*) AS n, avg(att_mean) AS mean, stddev_samp(att_mean) AS sd FROM (SELECT att_mean, ntile(4) OVER (ORDER BY delta_H_j, a.episode_id) AS bin FROM att a JOIN episodes e ON e.episode_id = a.episode_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    joined = mt.att(t.cf).join(t.episodes.select("episode_id", "delta_H_j"), "episode_id").withColumnRenamed("att_mean", "att")
    return placebo.subgroup_effects(joined, "delta_H_j")


def _meta(t: Tables, kind: str, model: str = "ridge") -> DataFrame:
    return meta.series(meta.cross_fit(t.stack, kind, meta.Learner(t.stack_features, model=model), meta.time_folds(t.stack, 12, 2)), kind)


@query("j18_t_learner", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    return _meta(t, "T")


@query("j19_s_learner", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    return _meta(t, "S")


@query("j20_x_learner", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    return _meta(t, "X")


@query("j24_meta_evaluation", SERIES + "rmspe_pre att_mean")
def _(t: Tables) -> DataFrame:
    cf = _meta(t, "S")
    return mt.fit(cf).join(mt.att(cf), ["episode_id", "model_type"])


@query("j16_forest_learner", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    spec = meta.Learner(t.stack_features, model="forest", params={"numTrees": 10, "maxDepth": 4})
    return meta.series(meta.cross_fit(t.stack, "S", spec, meta.time_folds(t.stack, 12, 1)), "S")


@query("j16_boosting_learner", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    spec = meta.Learner(t.stack_features, model="boosting", params={"maxIter": 5, "maxDepth": 3})
    return meta.series(meta.cross_fit(t.stack, "S", spec, meta.time_folds(t.stack, 12, 1)), "S")


@query("j16_boosted_propensity", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    spec = meta.Learner(t.stack_features, propensity="boosting", propensity_params={"maxIter": 5, "maxDepth": 3})
    return meta.series(meta.cross_fit(t.stack, "X", spec, meta.time_folds(t.stack, 12, 1)), "X")


@query("j17_count_target", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    spec = meta.for_target(t.stack, meta.Learner(t.stack_features))
    return meta.series(meta.cross_fit(t.stack, "S", spec, meta.time_folds(t.stack, 12, 1)), "S")


@query("j17_count_boosting", SERIES + "t:i y_obs mu0_hat")
def _(t: Tables) -> DataFrame:
    """Boosting with a Poisson loss, which the target calls for."""
    spec = meta.for_target(t.stack, meta.Learner(t.stack_features, model="boosting", params={"trees": 10, "depth": 3}))
    return meta.series(meta.cross_fit(t.stack, "S", spec, meta.time_folds(t.stack, 12, 1)), "S")


@query("j21_filled_predictions", "episode_id:s rows:i filled:i")
def _(t: Tables) -> DataFrame:
    out = meta.cross_fit(t.stack, "S", meta.Learner(t.stack_features), meta.time_folds(t.stack, 12, 2))
    return out.groupBy("episode_id").agg(F.count("*").alias("rows"), F.count("mu0_hat").alias("filled"))


@query("j22_tuned_parameters", "regParam score")
def _(t: Tables) -> DataFrame:
    best, score = meta.tune(t.stack, "S", meta.Learner(t.stack_features), meta.time_folds(t.stack, 12, 2), meta.random_params("ridge", 12), keep=0.25)
    return t.spark.createDataFrame([(best["regParam"], score)], "regParam double, score double")
