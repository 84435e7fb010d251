"""Pairs, episodes and donors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.operators import donors as dn
from promolens.operators import pairs as pr
from promolens.operators import runs as rn
from promolens.queries.registry import CTES, query
from promolens.queries.tables import Tables

CTES["h_profile"] = """
  SELECT store_nbr, item_nbr, class, count(*) AS n_obs, coalesce(avg((H_prop_raw > 0)::INT), 0) AS p_any, avg(H_prop_raw) AS h_mean, coalesce(stddev_pop(H_prop_raw), 0) AS h_sd
  FROM exposure GROUP BY ALL"""
CTES["p_profile"] = "SELECT store_nbr, item_nbr, count(*) AS n_rows, sum(onpromotion) AS n_on, avg(onpromotion) AS p_promo, min(t) AS first_t, max(t) AS last_t FROM panel GROUP BY ALL"
CTES["eligible"] = """
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY store_nbr, class) AS group_size FROM h_profile LEFT JOIN p_profile USING (store_nbr, item_nbr)
  WHERE n_obs >= 20 AND h_sd >= 0.004 AND p_any BETWEEN 0.02 AND 0.98) WHERE group_size >= 2"""
CTES["cannibals"] = "SELECT * FROM eligible WHERE p_promo BETWEEN 0.03 AND 0.25"
CTES["victims"] = """
  SELECT * FROM eligible JOIN (SELECT store_nbr, item_nbr, avg(onpromotion) AS p_window FROM panel WHERE t BETWEEN 53 AND 107 GROUP BY ALL) USING (store_nbr, item_nbr) WHERE p_window <= 0.16"""
CTES["class_days"] = "SELECT store_nbr, class, t, sum(H_prop_raw) AS s, count(H_prop_raw) AS c FROM exposure GROUP BY ALL"
CTES["cannibal_grid"] = """
  SELECT k.store_nbr, k.item_nbr, k.class, g.t, (r.n IS NOT NULL)::INT AS on_run,
         CASE WHEN g.c - (e.H_prop_raw IS NOT NULL)::INT > 0 THEN (coalesce(g.s, 0) - coalesce(e.H_prop_raw, 0)) / (g.c - (e.H_prop_raw IS NOT NULL)::INT) END AS m,
         CASE WHEN g.c > 0 THEN g.s / g.c END AS m_all
  FROM cannibals k JOIN class_days g ON g.store_nbr = k.store_nbr AND g.class = k.class
  LEFT JOIN exposure e ON e.store_nbr = k.store_nbr AND e.item_nbr = k.item_nbr AND e.t = g.t
  LEFT JOIN runs r ON r.store_nbr = k.store_nbr AND r.item_nbr = k.item_nbr AND g.t BETWEEN r.run_start AND r.run_end"""
_score = """
  SELECT store_nbr, item_nbr, class, avg({m}) FILTER (on_run = 1) - avg({m}) FILTER (on_run = 0) AS delta_H_cls, count({m}) FILTER (on_run = 1) AS n_on, count({m}) FILTER (on_run = 0) AS n_off
  FROM cannibal_grid GROUP BY ALL HAVING count({m}) FILTER (on_run = 1) > 0 AND count({m}) FILTER (on_run = 0) > 0"""
CTES["cannibal_scores"] = _score.format(m="m")
CTES["top_cannibals"] = "SELECT * FROM cannibal_scores ORDER BY delta_H_cls DESC, store_nbr, item_nbr LIMIT 40"
CTES["victim_scores"] = """
  SELECT k.store_nbr, k.class, k.item_nbr AS i_item, e.item_nbr AS j_item, avg(e.H_prop_raw) FILTER (r.n IS NOT NULL) - avg(e.H_prop_raw) FILTER (r.n IS NULL) AS delta_H_j,
         count(e.H_prop_raw) FILTER (r.n IS NOT NULL) AS n_obs_i_on, count(e.H_prop_raw) FILTER (r.n IS NULL) AS n_obs_i_off
  FROM top_cannibals k JOIN masked e ON e.store_nbr = k.store_nbr AND e.class = k.class AND e.item_nbr <> k.item_nbr AND e.in_run = 0
  JOIN victims v ON v.store_nbr = e.store_nbr AND v.item_nbr = e.item_nbr
  LEFT JOIN runs r ON r.store_nbr = k.store_nbr AND r.item_nbr = k.item_nbr AND e.t BETWEEN r.run_start AND r.run_end GROUP BY ALL"""
CTES["top_pairs"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, i_item ORDER BY delta_H_j DESC NULLS LAST, j_item) AS rank FROM victim_scores)
  WHERE rank <= 5 AND n_obs_i_on > 0 AND n_obs_i_off > 0"""
CTES["all_episodes"] = """
  SELECT *, i_store || '-' || i_item || '_' || j_store || '-' || j_item || '_' || treat_start AS episode_id FROM (
    SELECT p.*, p.store_nbr AS i_store, p.store_nbr AS j_store, run_start - 13 AS pre_start, run_start - 2 AS pre_end, run_start AS treat_start,
           least(run_end, run_start + 2) AS treat_end, least(run_end, run_start + 2) + 1 AS post_start, least(run_end, run_start + 2) + 6 AS post_end
    FROM top_pairs p JOIN (SELECT store_nbr, item_nbr, min(run_start) AS run_start, min_by(run_end, run_start) AS run_end FROM runs GROUP BY ALL) f ON f.store_nbr = p.store_nbr AND f.item_nbr = p.i_item)"""
_stats = """
  SELECT u.episode_id, u.store_nbr, u.item_nbr, count(unit_sales) AS n_pre, avg(unit_sales) AS pre_mean, stddev_pop(unit_sales) AS pre_sd, min(unit_sales) AS pre_min, max(unit_sales) AS pre_max,
         quantile_cont(unit_sales, 0.95) AS pre_p95, avg((unit_sales = 0)::INT) AS zero_share, CASE WHEN abs(avg(unit_sales)) > 1e-9 THEN stddev_pop(unit_sales) / avg(unit_sales) END AS cv,
         count(unit_sales) / max(pre_end - pre_start + 1)::DOUBLE AS coverage
  FROM {units} u JOIN panel p ON p.store_nbr = u.store_nbr AND p.item_nbr = u.item_nbr AND p.t BETWEEN pre_start AND pre_end GROUP BY ALL"""
CTES["victim_windows"] = "SELECT episode_id, j_store AS store_nbr, j_item AS item_nbr, pre_start, pre_end FROM all_episodes"
CTES["victim_stats"] = _stats.format(units="victim_windows")
CTES["episodes"] = "SELECT * FROM all_episodes WHERE episode_id IN (SELECT episode_id FROM victim_stats WHERE coverage >= 0.4 AND pre_sd >= 0.003 AND abs(pre_mean) >= 0.01 AND zero_share <= 0.8 AND coalesce(cv, 0) <= 3)"
CTES["profiles"] = "SELECT store_nbr, item_nbr, h_mean, h_sd, p_any, i.class, type, city, state FROM h_profile h JOIN items i USING (item_nbr) JOIN stores s USING (store_nbr)"
_cand = """
  SELECT e.episode_id, e.j_store, e.j_item, d.store_nbr, d.item_nbr, '{kind}' AS donor_kind, d.type, d.city, d.state, e.pre_start, e.pre_end,
         sqrt(0.5 * (d.h_mean - v.h_mean) ** 2 + 0.2 * (d.h_sd - v.h_sd) ** 2 + 0.3 * (d.p_any - v.p_any) ** 2) AS distance
  FROM episodes e JOIN profiles v ON v.store_nbr = e.j_store AND v.item_nbr = e.j_item JOIN profiles d ON {on} AND d.store_nbr <> e.j_store AND d.store_nbr <> e.i_store"""
CTES["donor_all"] = _cand.format(kind="same_item", on="d.item_nbr = e.j_item") + " UNION ALL " + _cand.format(kind="same_class", on="d.class = e.class AND d.item_nbr <> e.j_item")
CTES["donor_near"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, donor_kind ORDER BY distance, store_nbr, item_nbr) AS near FROM donor_all) WHERE near <= 120"
CTES["donor_own"] = _stats.format(units="donor_near")
CTES["donor_stats"] = """
  SELECT *, gap / greatest(abs(v_pre_mean), 1e-6) AS rel FROM (
  SELECT c.*, o.pre_mean, o.pre_sd, o.pre_min, o.pre_max, o.pre_p95, o.coverage, v.pre_mean AS v_pre_mean, v.pre_sd AS v_pre_sd, v.pre_max AS v_pre_max, v.pre_p95 AS v_pre_p95, abs(o.pre_mean - v.pre_mean) AS gap
  FROM donor_near c JOIN donor_own o USING (episode_id, store_nbr, item_nbr) JOIN victim_stats v ON v.episode_id = c.episode_id)"""
CTES["donor_scored"] = "SELECT *, (0.5 * rel + 0.5 * distance) * CASE WHEN rel <= 0.5 THEN 0.85 ELSE 1 END AS score, CASE WHEN pre_mean >= v_pre_mean THEN 'above' ELSE 'below' END AS side FROM donor_stats"
CTES["donor_good"] = """
  SELECT * FROM donor_scored WHERE coverage >= 0.4 AND pre_sd >= 0.003 AND pre_min >= 0 AND (v_pre_mean <= 0 OR pre_mean <= 4 * v_pre_mean) AND (v_pre_p95 <= 0 OR pre_p95 <= 5 * v_pre_p95)
    AND (v_pre_max <= 0 OR pre_max <= 8 * v_pre_max) AND (abs(v_pre_mean) <= 1e-6 OR gap <= abs(v_pre_mean)) AND (v_pre_sd <= 1e-6 OR pre_sd <= 3 * v_pre_sd)"""
CTES["pick_item"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY tier, score, store_nbr, item_nbr) AS pos FROM (
    SELECT *, (row_number() OVER (PARTITION BY episode_id, side ORDER BY score, store_nbr, item_nbr) > 3)::INT AS tier FROM (
      SELECT *, row_number() OVER (PARTITION BY episode_id, store_nbr ORDER BY score, item_nbr) AS o FROM donor_good WHERE donor_kind = 'same_item') WHERE o = 1)) WHERE pos <= 6"""
CTES["pick_class"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY tier, score, store_nbr, item_nbr) AS pos FROM (
    SELECT *, (row_number() OVER (PARTITION BY episode_id, side ORDER BY score, store_nbr, item_nbr) > greatest(3, floor(slots / 2)))::INT AS tier FROM (
      SELECT g.*, 10 - coalesce(taken, 0) AS slots FROM donor_good g LEFT JOIN (SELECT episode_id, count(*) AS taken FROM pick_item GROUP BY 1) USING (episode_id) WHERE donor_kind = 'same_class'))) WHERE pos <= slots"""
CTES["picked"] = "SELECT episode_id, store_nbr, item_nbr FROM pick_item UNION ALL SELECT episode_id, store_nbr, item_nbr FROM pick_class"
CTES["pick_fill"] = """
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.episode_id ORDER BY (donor_kind <> 'same_class')::INT, distance, s.store_nbr, s.item_nbr) AS pos, 10 - coalesce(have, 0) AS need
    FROM donor_scored s LEFT JOIN (SELECT episode_id, count(*) AS have FROM picked GROUP BY 1) h ON h.episode_id = s.episode_id
    WHERE (s.episode_id, s.store_nbr, s.item_nbr) NOT IN (SELECT (episode_id, store_nbr, item_nbr) FROM picked)) WHERE pos <= need"""
_cols = "episode_id, j_store, j_item, store_nbr, item_nbr, donor_kind, distance, score, side"
CTES["chosen"] = f"SELECT {_cols}, 0 AS fallback FROM pick_item UNION ALL SELECT {_cols}, 0 FROM pick_class UNION ALL SELECT {_cols}, 1 FROM pick_fill"
CTES["donor_ranked"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY j_store, j_item ORDER BY (donor_kind <> 'same_item')::INT, distance, store_nbr, item_nbr) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY j_store, j_item, store_nbr, item_nbr ORDER BY (donor_kind <> 'same_item')::INT, distance, episode_id) AS o FROM chosen) WHERE o = 1) WHERE rank <= 10"""
CTES["donors"] = "SELECT e.episode_id, e.j_store, e.j_item, d.store_nbr, d.item_nbr, d.donor_kind, d.distance, d.rank FROM episodes e LEFT JOIN donor_ranked d ON d.j_store = e.j_store AND d.j_item = e.j_item"

UNIT = "store_nbr:i item_nbr:i "


@query("d4_exposure_profile", UNIT + "class:i n_obs:i p_any h_mean h_sd", "SELECT * FROM h_profile")
def _(t: Tables) -> DataFrame:
    return pr.exposure_profile(t.exposed)


@query("d5_promo_profile", UNIT + "n_rows:i n_on:i p_promo first_t:i last_t:i", "SELECT * FROM p_profile")
def _(t: Tables) -> DataFrame:
    return pr.promo_profile(t.sales)


@query("d6_group_metrics", UNIT + "class:i n_obs_H:i h_mean h_sd p_any", "SELECT store_nbr, item_nbr, class, count(H_prop_raw) AS n_obs_H, avg(H_prop_raw) AS h_mean, coalesce(stddev_samp(H_prop_raw), 0) AS h_sd, avg((H_prop_raw > 0)::INT) AS p_any FROM exposure GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return pr.group_metrics(t.exposed)


@query("d7_collapse_exposure", UNIT + "t:i H_prop H_bin:i", "SELECT store_nbr, item_nbr, t, avg(H_prop_raw) AS H_prop, max(H_bin) AS H_bin FROM exposure GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return pr.collapse_exposure(t.exposed)


@query("c4_candidate_base", UNIT + "n_obs:i h_sd p_promo", "SELECT * FROM h_profile LEFT JOIN p_profile USING (store_nbr, item_nbr)")
def _(t: Tables) -> DataFrame:
    return t.base


@query("b7_eligible_units", UNIT + "n_obs:i h_sd p_any", "SELECT * FROM h_profile WHERE n_obs >= 20 AND h_sd >= 0.004 AND p_any BETWEEN 0.02 AND 0.98")
def _(t: Tables) -> DataFrame:
    return pr.eligible(t.base, t.cfg)


@query("b8_group_size", UNIT + "class:i group_size:i", "SELECT * FROM eligible")
def _(t: Tables) -> DataFrame:
    return pr.large_groups(pr.eligible(t.base, t.cfg))


@query("b9_cannibals_and_victims", "kind:s " + UNIT + "p", "SELECT 'i' AS kind, store_nbr, item_nbr, p_promo AS p FROM cannibals UNION ALL SELECT 'j', store_nbr, item_nbr, p_window FROM victims")
def _(t: Tables) -> DataFrame:
    i = t.cannibals.select(F.lit("i").alias("kind"), "store_nbr", "item_nbr", F.col("p_promo").alias("p"))
    return i.union(t.victims.select(F.lit("j"), "store_nbr", "item_nbr", "p_window"))


@query("f9_stratified_sample", UNIT + "class:i", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, class ORDER BY md5(concat_ws('|', store_nbr, item_nbr, 42))) AS k, least(ceil(count(*) OVER (PARTITION BY store_nbr, class) * 0.25), 50) AS keep FROM cannibals) WHERE k <= keep""")
def _(t: Tables) -> DataFrame:
    return pr.sample_groups(t.cannibals, 0.25, 50)


@query("f10_pool_sample", UNIT + "class:i", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_nbr, class ORDER BY md5(concat_ws('|', store_nbr, item_nbr, 7))) AS k, least(ceil(count(*) OVER (PARTITION BY store_nbr, class) * 0.5), 2) AS keep FROM victims) WHERE k <= keep""")
def _(t: Tables) -> DataFrame:
    return pr.sample_groups(t.victims, 0.5, 2, seed=7)


@query("d16_cannibal_scores", UNIT + "class:i delta_H_cls n_on:i n_off:i", "SELECT * FROM cannibal_scores")
def _(t: Tables) -> DataFrame:
    return t.cannibal_scores


@query("d16_cannibal_scores_fast", UNIT + "class:i delta_H_cls n_on:i n_off:i", _score.format(m="m_all"))
def _(t: Tables) -> DataFrame:
    return pr.score_cannibals(t.cannibals, t.exposed, t.found_runs, exact=False)


@query("f5_top_cannibals", UNIT + "class:i delta_H_cls", "SELECT * FROM top_cannibals")
def _(t: Tables) -> DataFrame:
    return t.top_cannibals


PAIR = "store_nbr:i class:i i_item:i j_item:i delta_H_j n_obs_i_on:i n_obs_i_off:i"


@query("d17_victim_scores", PAIR, "SELECT * FROM victim_scores")
def _(t: Tables) -> DataFrame:
    return t.victim_scores


@query("f6_top_victims", PAIR, "SELECT * FROM top_pairs")
def _(t: Tables) -> DataFrame:
    return pr.top_victims(t.victim_scores, t.cfg.top_victims)


EPISODE = "episode_id:s i_store:i i_item:i j_store:i j_item:i class:i delta_H_j pre_start:i pre_end:i treat_start:i treat_end:i post_start:i post_end:i"


@query("h6_episode_windows", EPISODE, "SELECT * FROM all_episodes")
def _(t: Tables) -> DataFrame:
    return t.all_episodes


@query("d14_pre_stats", "episode_id:s " + UNIT + "n_pre:i pre_mean pre_sd pre_min coverage zero_share cv", "SELECT * FROM victim_stats")
def _(t: Tables) -> DataFrame:
    return pr.window_stats(t.victim_windows, t.sales)


@query("b10_pre_quality", "episode_id:s coverage pre_sd pre_mean", "SELECT * FROM victim_stats WHERE coverage >= 0.4 AND pre_sd >= 0.003 AND abs(pre_mean) >= 0.01")
def _(t: Tables) -> DataFrame:
    return pr.pre_quality(pr.window_stats(t.victim_windows, t.sales), t.cfg)


@query("b11_easy_episodes", "episode_id:s zero_share cv", "SELECT * FROM victim_stats WHERE zero_share <= 0.8 AND coalesce(cv, 0) <= 0.5")
def _(t: Tables) -> DataFrame:
    return pr.window_stats(t.victim_windows, t.sales).filter("zero_share <= 0.8 AND coalesce(cv, 0) <= 0.5")


@query("a10_episodes", EPISODE, "SELECT * FROM episodes")
def _(t: Tables) -> DataFrame:
    return t.episodes


@query("f7_top_episodes", "episode_id:s delta_H_j", "SELECT * FROM episodes ORDER BY abs(delta_H_j) DESC, i_store, i_item, j_store, j_item, treat_start, episode_id LIMIT 15")
def _(t: Tables) -> DataFrame:
    return pr.subset(t.episodes, "top_delta_abs", 15)


@query("f7_random_episodes", "episode_id:s", "SELECT * FROM episodes ORDER BY md5(concat_ws('|', episode_id, 42)) LIMIT 10")
def _(t: Tables) -> DataFrame:
    return pr.subset(t.episodes, "random", 10)


@query("c19_explicit_episodes", "episode_id:s delta_H_j", "SELECT * FROM episodes WHERE j_item % 2 = 0")
def _(t: Tables) -> DataFrame:
    return pr.subset(t.episodes, "explicit", 0, allowed=t.episodes.filter("j_item % 2 = 0").select("episode_id"))


@query("f8_frequent_pairs", "episode_id:s delta_H_j n_pairs:i", """
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY i_store, i_item) AS n_pairs, row_number() OVER (PARTITION BY i_store, i_item ORDER BY delta_H_j DESC, j_store, j_item) AS v FROM episodes
  WHERE (i_store, i_item) IN (SELECT (i_store, i_item) FROM (SELECT i_store, i_item, count(*) AS k FROM episodes GROUP BY ALL ORDER BY k DESC, i_store, i_item LIMIT 8))) WHERE v <= 2""")
def _(t: Tables) -> DataFrame:
    return pr.frequent(t.episodes, 8, 2)


@query("f18_episode_index", "episode_id:s i_unit:s j_unit:s class:i pre_days:i post_days:i", """
  SELECT episode_id, i_store || ':' || i_item AS i_unit, j_store || ':' || j_item AS j_unit, class, greatest(treat_start - pre_start, 0) AS pre_days, greatest(post_end - post_start + 1, 0) AS post_days FROM episodes""")
def _(t: Tables) -> DataFrame:
    return pr.episode_index(t.episodes)


@query("h8_effective_lengths", "episode_id:s pre_days:i post_days:i", "SELECT episode_id, greatest(treat_start - pre_start, 0) AS pre_days, greatest(post_end - post_start + 1, 0) AS post_days FROM all_episodes")
def _(t: Tables) -> DataFrame:
    return pr.episode_index(t.all_episodes)


_role = "SELECT episode_id, unnest(range({a}, {b} + 1)) AS t, '{r}' AS role, {p} AS p FROM episodes"


@query("h7_role_calendar", "episode_id:s t:i role:s", "SELECT episode_id, t, min_by(role, p) AS role FROM (" + " UNION ALL ".join(
    _role.format(a=a, b=b, r=r, p=p) for r, p, a, b in (("treat", 0, "treat_start", "treat_end"), ("guard_pre", 1, "treat_start - 1", "treat_start - 1"), ("guard_post", 2, "treat_end + 1", "treat_end + 1"), ("pre", 3, "pre_start", "pre_end"), ("post", 4, "post_start", "post_end"))) + ") GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rn.role_calendar(t.episodes)


@query("c3_profiles", UNIT + "class:i h_mean h_sd p_any type:s city:s state:s", "SELECT * FROM profiles")
def _(t: Tables) -> DataFrame:
    return t.profiles


CAND = "episode_id:s " + UNIT + "donor_kind:s distance"


@query("c9_same_item_candidates", CAND, "SELECT * FROM donor_near WHERE donor_kind = 'same_item'")
def _(t: Tables) -> DataFrame:
    return t.donor_candidates.filter("donor_kind = 'same_item'")


@query("c10_same_class_candidates", CAND, "SELECT * FROM donor_near WHERE donor_kind = 'same_class'")
def _(t: Tables) -> DataFrame:
    return t.donor_candidates.filter("donor_kind = 'same_class'")


@query("f1_nearest_candidates", CAND, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, donor_kind ORDER BY distance, store_nbr, item_nbr) AS k FROM donor_all) WHERE k <= 20")
def _(t: Tables) -> DataFrame:
    """Fewer than the flow's own cut, so that the cut takes effect in these small classes."""
    return dn.candidates(t.episodes, t.profiles, 20)


@query("h10_profile_distance", CAND, "SELECT * FROM donor_near WHERE distance <= 0.05")
def _(t: Tables) -> DataFrame:
    return t.donor_candidates.filter("distance <= 0.05")


@query("d15_donor_stats", "episode_id:s " + UNIT + "pre_mean pre_sd pre_p95 pre_max coverage", "SELECT * FROM donor_stats")
def _(t: Tables) -> DataFrame:
    return t.donor_stats


@query("b12_donor_filters", "episode_id:s " + UNIT + "donor_kind:s", "SELECT * FROM donor_good")
def _(t: Tables) -> DataFrame:
    return dn.hard_filters(t.donor_stats, t.cfg)


@query("h11_donor_score", "episode_id:s " + UNIT + "score side:s", "SELECT * FROM donor_scored")
def _(t: Tables) -> DataFrame:
    return dn.scored(t.donor_stats, t.cfg.donor_alpha)


@query("f2_same_item_pick", "episode_id:s " + UNIT + "score", "SELECT * FROM pick_item")
def _(t: Tables) -> DataFrame:
    return t.chosen.filter("donor_kind = 'same_item' AND fallback = 0")


@query("f3_same_class_pick", "episode_id:s " + UNIT + "score", "SELECT * FROM pick_class")
def _(t: Tables) -> DataFrame:
    return t.chosen.filter("donor_kind = 'same_class' AND fallback = 0")


@query("f4_fallback_donors", "episode_id:s " + UNIT + "distance", "SELECT * FROM pick_fill")
def _(t: Tables) -> DataFrame:
    return t.chosen.filter("fallback = 1")


@query("g2_donor_union", "episode_id:s " + UNIT + "donor_kind:s fallback:i", "SELECT * FROM chosen")
def _(t: Tables) -> DataFrame:
    return t.chosen


@query("e15_donor_ranks", "j_store:i j_item:i " + UNIT + "donor_kind:s distance rank:i", "SELECT * FROM donor_ranked")
def _(t: Tables) -> DataFrame:
    return t.donor_ranked


@query("c8_donors_per_episode", "episode_id:s " + UNIT + "rank:i", "SELECT * FROM donors")
def _(t: Tables) -> DataFrame:
    return t.donors


@query("f12_top_donors", "episode_id:s " + UNIT + "rank:i", "SELECT * FROM donors WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    return t.donors.filter("rank <= 3")


@query("a11_donors_by_kind", "episode_id:s " + UNIT + "rank:i", "SELECT * FROM donors WHERE donor_kind = 'same_item'")
def _(t: Tables) -> DataFrame:
    return t.donors.filter("donor_kind = 'same_item'")


CTES["treated_units"] = "SELECT j_store AS store_nbr, j_item AS item_nbr FROM episodes UNION SELECT i_store, i_item FROM episodes"


@query("c12_never_treated", "episode_id:s " + UNIT + "rank:i", "SELECT * FROM donors WHERE store_nbr IS NOT NULL AND (store_nbr, item_nbr) NOT IN (SELECT (store_nbr, item_nbr) FROM treated_units)")
def _(t: Tables) -> DataFrame:
    return dn.never_treated(t.donors, t.episodes).filter("store_nbr IS NOT NULL")


@query("c13_self_donors", "n:i n_self:i share", "SELECT count(*) AS n, sum((store_nbr = j_store AND item_nbr = j_item)::INT) AS n_self, avg((store_nbr = j_store AND item_nbr = j_item)::INT) AS share FROM donors")
def _(t: Tables) -> DataFrame:
    return dn.self_donors(t.donors)


@query("g1_unit_universe", UNIT, "SELECT store_nbr, item_nbr FROM treated_units UNION SELECT store_nbr, item_nbr FROM donors WHERE store_nbr IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.universe
