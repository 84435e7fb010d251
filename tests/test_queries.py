"""Every registered query of the smallest tables against its SQL, for a sample of cheap ones."""

import duckdb
import pytest

from promolens.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "a1_sales_panel", "a2_required_columns", "d1_collapse_sales", "e1_competitive_exposure", "e3_ema", "e3_ema_of_long_series", "e4_winsorise", "e5_runs", "d16_cannibal_scores", "e9_sales_history", "k2_sessions", "b15_feature_panel", "i12_full_audit",
    "e20_sales_buckets", "d48_iqr_bound", "d27_sensitivity", "d29_leave_one_out", "d57_radar", "j28_report", "j29_robustness", "j6_rolling_folds", "j7_holdout_mask", "j7_holdout_mask_all_rows", "d52_subgroup_effects", "a20_json_report",
    "a17_leave_one_out_sink", "a17_sensitivity_sink", "c17_coverage_flags", "d54_comparison", "g6_common_cells", "f1_nearest_candidates", "h13_count_target", "d36_date_store_matrix", "e7_gap_runs", "d15_donor_stats", "b12_donor_filters", "h11_donor_score", "k1_daily_exposure", "g7_panel_stack",
]


def rows(records):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in records)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == names
    assert rows(df.select(names).collect()) == rows(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_names_match():
    assert set(SQL) <= set(QUERIES)
