"""Sources, predicates, cleaning, audits, scalar functions, exposure and runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.functions import scalars as sc
from promolens.operators import exposure as ex
from promolens.operators import quality as q
from promolens.operators import runs as rn
from promolens.queries.registry import CTES, query
from promolens.queries.tables import Tables
from promolens.schema import cast_existing, ensure_columns, first_existing, rename_synonyms, require_columns, safe_features
from promolens.sources.testdata import HOLIDAY_ROWS

_first = "min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_quantity, f := l_extendedprice, g := l_discount)).g"
CTES["lines"] = """
  SELECT l.*, date_trunc('month', l_shipdate)::DATE AS date, s_nationkey::INT AS store_nbr, substr(p_brand, 7)::INT AS item_nbr
  FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"""
CTES["panel"] = f"""
  SELECT date, ((year(date) - 1992) * 12 + month(date) - 1)::INT AS t, store_nbr, item_nbr, (item_nbr - 1) % 5 AS class,
         sum(l_quantity) AS unit_sales, ({_first} >= 0.09)::INT AS onpromotion
  FROM lines GROUP BY date, store_nbr, item_nbr"""
CTES["items"] = """
  SELECT DISTINCT substr(p_brand, 7)::INT AS item_nbr, ((substr(p_brand, 7)::INT - 1) % 5)::VARCHAR AS family,
         (substr(p_brand, 7)::INT - 1) % 5 AS class, substr(p_brand, 7)::INT % 2 AS perishable FROM part"""
CTES["stores"] = """
  SELECT n_nationkey::INT AS store_nbr, n_name AS city, r_name AS state, chr((65 + n_nationkey % 5)::INT) AS type, n_nationkey::INT % 4 AS cluster
  FROM nation JOIN region ON n_regionkey = r_regionkey"""
CTES["transactions"] = "SELECT date, store_nbr, count(DISTINCT l_orderkey) AS transactions FROM lines GROUP BY ALL"
CTES["oil"] = """
  SELECT date, CASE WHEN month(date) <> 1 THEN price END AS dcoilwtico FROM (
    SELECT date_trunc('month', o_orderdate)::DATE AS date, avg(o_totalprice) AS price FROM orders GROUP BY 1)"""
CTES["holidays"] = "SELECT * FROM (VALUES " + ", ".join(
    "(DATE '{}', '{}', '{}', '{}', '{}', {})".format(*r[:5], "NULL" if r[5] is None else str(r[5]).upper()) for r in HOLIDAY_ROWS
) + ") AS h(date, type, locale, locale_name, description, transferred)"
CTES["exposure"] = """
  SELECT *, CASE WHEN n > 1 THEN H_disc / (n - 1)::DOUBLE END AS H_prop_raw,
         (coalesce(CASE WHEN n > 1 THEN H_disc / (n - 1)::DOUBLE END, 0) >= 0.02)::INT AS H_bin
  FROM (SELECT *, count(*) OVER g AS n, (sum(onpromotion) OVER g - onpromotion)::INT AS H_disc FROM panel WINDOW g AS (PARTITION BY date, store_nbr, class))"""
CTES["runs"] = """
  SELECT store_nbr, item_nbr, min(t) AS run_start, max(t) AS run_end, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY t)
            - row_number() OVER (PARTITION BY store_nbr, item_nbr, onpromotion ORDER BY t) AS island
    FROM panel WHERE t BETWEEN 53 AND 107)
  WHERE onpromotion = 1 GROUP BY store_nbr, item_nbr, island HAVING count(*) >= 2"""

PANEL = "date:d t:i store_nbr:i item_nbr:i class:i unit_sales onpromotion:i"


# A: sources
@query("a1_sales_panel", PANEL, "SELECT * FROM panel")
def _(t: Tables) -> DataFrame:
    return require_columns(t.sales, ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"], "sales")


@query("a1_synonym_scan", "date:d store_nbr:i item_nbr:i sales family:s", "SELECT date, store_nbr, item_nbr, unit_sales AS sales, family FROM panel JOIN items USING (item_nbr)")
def _(t: Tables) -> DataFrame:
    given = t.sales.select("date", "store_nbr", F.col("item_nbr").alias("item_id"), F.col("unit_sales").alias("units"))
    named = rename_synonyms(given, {"item_nbr": ("item_id", "item"), "sales": ("unit_sales", "units")})
    return named.join(t.items(), "item_nbr", "left")


@query("a3_dimensions", "kind:s id:i name:s", "SELECT 'item' AS kind, item_nbr AS id, family AS name FROM items UNION ALL SELECT 'store', store_nbr, city FROM stores")
def _(t: Tables) -> DataFrame:
    return t.items().select(F.lit("item").alias("kind"), F.col("item_nbr").alias("id"), F.col("family").alias("name")).union(t.stores().select(F.lit("store"), "store_nbr", "city"))


@query("a4_transactions", "date:d store_nbr:i transactions", "SELECT date, store_nbr, transactions FROM transactions")
def _(t: Tables) -> DataFrame:
    return q.clean_transactions(t.transactions())


@query("a5_oil_filled", "date:d price", """
  SELECT date, coalesce(last_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING),
         first_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM oil""")
def _(t: Tables) -> DataFrame:
    from promolens.operators.features import fill_both_ways

    return fill_both_ways(t.oil(), "dcoilwtico", "price")


@query("a6_holidays", "date:d type:s locale:s locale_name:s transferred:s units:i", """
  SELECT h.date, type, locale, locale_name, coalesce(transferred, false)::VARCHAR AS transferred, count(p.date) AS units FROM holidays h LEFT JOIN panel p ON p.date = h.date GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    h = t.holidays().withColumn("transferred", F.coalesce("transferred", F.lit(False)))
    cells = t.sales.groupBy("date").agg(F.count("*").alias("units"))
    return h.join(cells, "date", "left").na.fill(0, ["units"])


@query("a7_projected_filter", "store_nbr:i item_nbr:i unit_sales", "SELECT store_nbr, item_nbr, unit_sales FROM panel WHERE date >= DATE '1998-01-01' AND onpromotion = 1")
def _(t: Tables) -> DataFrame:
    return q.since(t.sales, "1998-01-01").filter("onpromotion = 1").select("store_nbr", "item_nbr", "unit_sales")


# B: projections and predicates
_flag_text = "CASE WHEN lower(trim(x)) IN ('', '0', 'false', 'f', 'no', 'n', 'nan', 'none', 'null', 'na') OR x IS NULL THEN 0 ELSE 1 END"


@query("b1_promo_flag_rules", "event_id:i by_text:i by_number:i by_clip:i", f"""
  SELECT event_id, {_flag_text} AS by_text,
         coalesce(trunc(least(greatest(TRY_CAST(trim(x) AS DOUBLE), 0), 1)), (lower(trim(x)) IN ('true', 't', '1', 'yes'))::INT, 0) AS by_number,
         coalesce(trunc(least(greatest(TRY_CAST(trim(x) AS DOUBLE), 0), 1)), 0) AS by_clip
  FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' yes ' WHEN 1 THEN '0' WHEN 2 THEN NULL WHEN 3 THEN 'T' WHEN 4 THEN '0.5' WHEN 5 THEN '3' ELSE event_type END AS x FROM events)""")
def _(t: Tables) -> DataFrame:
    e, k = t.raw("events"), F.col("event_id") % 7
    x = F.when(k == 0, " yes ").when(k == 1, "0").when(k == 2, None).when(k == 3, "T").when(k == 4, "0.5").when(k == 5, "3").otherwise(F.col("event_type"))
    return e.select("event_id", *[sc.promo_flag(x, r).alias(n) for r, n in (("text", "by_text"), ("numeric", "by_number"), ("clip", "by_clip"))])


@query("b2_lenient_dates", "year:i n:i bad:i", """
  SELECT year(TRY_CAST(x AS DATE)) AS year, count(*) AS n, sum((TRY_CAST(x AS DATE) IS NULL)::INT) AS bad
  FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE o_orderdate::DATE::VARCHAR END AS x FROM orders) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    d = t.raw("orders").select(sc.lenient_date(x).alias("d"))
    return d.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("d").isNull().cast("int")).alias("bad"))


@query("b3_safe_numeric", "event_type:s n:i total", """
  SELECT event_type, count(TRY_CAST(x AS DOUBLE)) AS n, sum(TRY_CAST(x AS DOUBLE)) AS total
  FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS x FROM events) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return cast_existing(t.raw("events").select("event_type", x.alias("x")), {"x": "double"}).groupBy("event_type").agg(F.count("x").alias("n"), F.sum("x").alias("total"))


@query("b4_min_date", PANEL, "SELECT * FROM panel WHERE date >= DATE '1999-01-01'")
def _(t: Tables) -> DataFrame:
    return q.since(t.sales, "1999-01-01")


@query("b5_clean_transactions", "c_custkey:i balance", "SELECT c_custkey, greatest(coalesce(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END, 0), 0) AS balance FROM customer")
def _(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", sc.non_negative(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))).alias("balance"))


@query("b17_ensure_and_cast", "store_nbr:i cluster:i region:s", "SELECT store_nbr, cluster, NULL AS region FROM stores")
def _(t: Tables) -> DataFrame:
    return ensure_columns(cast_existing(t.stores(), {"cluster": "int", "absent": "int"}), {"region": "string"})


@query("b18_pick_column", "date:d store_nbr:i item_nbr:i treated:i", "SELECT date, store_nbr, item_nbr, onpromotion AS treated FROM panel")
def _(t: Tables) -> DataFrame:
    return t.sales.withColumn("treated", F.col(first_existing(t.sales, "H_disc", "treatment", "onpromotion")))


@query("b22_model_labels", "label:s n:i", """
  SELECT CASE WHEN x LIKE 'gsc%' OR x LIKE 'synth%' THEN 'GSC' WHEN regexp_matches(x, '(^|[_-])[stx](-?learner)?$')
         THEN upper(regexp_extract(x, '([stx])(-?learner)?$', 1)) ELSE upper(x) END AS label, count(*) AS n
  FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'gsc_v2' WHEN 1 THEN 't-learner' WHEN 2 THEN 'meta_x' WHEN 3 THEN 's' ELSE event_type END AS x FROM events) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    x = F.when(k == 0, "gsc_v2").when(k == 1, "T-Learner").when(k == 2, "meta_x").when(k == 3, " S ").otherwise(F.col("event_type"))
    return t.raw("events").groupBy(sc.model_label(x).alias("label")).agg(F.count("*").alias("n"))


@query("b14_safe_features", "name:s n:i", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM panel" for c in ("t", "store_nbr", "item_nbr", "class")))
def _(t: Tables) -> DataFrame:
    names = safe_features(t.exposed, {"unit_sales", "onpromotion"}, ("H_",))
    one = t.exposed.agg(*[F.count(n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.name", "r.n")


# D1-D3, C1, C14, C15 and I: cleaning and audits
_last = "max_by(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice))"


@query("d1_collapse_sales", "date:d store_nbr:i item_nbr:i onpromotion:i unit_sales l_extendedprice", f"""
  SELECT date, store_nbr, item_nbr, max((l_discount >= 0.09)::INT) AS onpromotion, sum(l_quantity) AS unit_sales, {_last} AS l_extendedprice FROM lines GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return q.collapse_sales(t.raw_sales, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_extendedprice"])


@query("d2_collapse_transactions", "date:d store_nbr:i transactions", "SELECT date, store_nbr, count(*) AS transactions FROM lines GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return q.collapse_transactions(t.lines().withColumn("transactions", F.lit(1)))


@query("d3_sales_summary", "n_rows:i first_date:d last_date:d n_stores:i n_items:i promo_rate null_rate negative_rate min_store_rows:i max_store_rows:i", """
  SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT store_nbr) AS n_stores, count(DISTINCT item_nbr) AS n_items, avg(onpromotion) AS promo_rate,
         avg((unit_sales IS NULL)::INT) AS null_rate, avg((unit_sales < 0)::INT) AS negative_rate,
         (SELECT min(n) FROM (SELECT count(*) AS n FROM panel GROUP BY store_nbr)) AS min_store_rows, (SELECT max(n) FROM (SELECT count(*) AS n FROM panel GROUP BY store_nbr)) AS max_store_rows FROM panel""")
def _(t: Tables) -> DataFrame:
    return q.sales_summary(t.sales)


@query("d3_transactions_summary", "n_rows:i first_date:d last_date:d n_stores:i transactions:i", "SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT store_nbr) AS n_stores, sum(transactions) AS transactions FROM transactions")
def _(t: Tables) -> DataFrame:
    return q.transactions_summary(t.transactions())


ISSUE = "dataset:s check:s severity:s n_affected:i n_rows:i"


def _issue(dataset: str, check: str, severity: str, bad: str, source: str) -> str:
    return f"SELECT '{dataset}' AS dataset, '{check}' AS \"check\", '{severity}' AS severity, coalesce(sum(({bad})::INT), 0) AS n_affected, count(*) AS n_rows FROM {source}"


@query("i1_required_columns", ISSUE, "SELECT 'sales' AS dataset, 'columns' AS \"check\", 'error' AS severity, 1 AS n_affected, count(*) AS n_rows FROM panel")
def _(t: Tables) -> DataFrame:
    found = q.missing_columns(t.sales, "sales", ["date", "store_nbr", "price"]).drop("n_rows").withColumn("k", F.lit(1))
    return found.join(t.sales.agg(F.count("*").alias("n_rows")).withColumn("k", F.lit(1)), "k")  # one row each


@query("i2_non_numeric", ISSUE, _issue("events", "non_numeric_props", "error", "props IS NOT NULL AND TRY_CAST(props AS DOUBLE) IS NULL", "events"))
def _(t: Tables) -> DataFrame:
    return q.non_numeric(t.raw("events"), "events", "props")


@query("i3_not_boolean", ISSUE, _issue("orders", "not_boolean_o_orderstatus", "warning", "lower(o_orderstatus) NOT IN ('1', 'true', 't', 'yes', 'y', 'si', 'sí', '0', 'false', 'f', 'no', 'n')", "orders"))
def _(t: Tables) -> DataFrame:
    return q.not_boolean(t.raw("orders"), "orders", "o_orderstatus")


@query("i4_duplicate_keys", ISSUE, _issue("lines", "duplicate_keys", "error", "n > 1", "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"))
def _(t: Tables) -> DataFrame:
    return q.duplicate_keys(t.raw("lineitem"), "lines", ["l_orderkey", "l_linenumber"])


@query("i4_duplicate_samples", "l_orderkey:i l_linenumber:i n:i", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 10")
def _(t: Tables) -> DataFrame:
    return q.duplicate_samples(t.raw("lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("count", "n")


@query("i5_date_range", ISSUE, _issue("sales", "date_range", "warning", "date NOT BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'", "panel"))
def _(t: Tables) -> DataFrame:
    return q.date_range(t.sales, "sales", "1993-01-01", "1997-12-31")


@query("d48_weekly_negative", ISSUE, _issue("customers", "weekly_negative", "warning", "s < -1", "(SELECT sum(c_acctbal) AS s FROM customer GROUP BY c_nationkey, c_custkey % 7)"))
def _(t: Tables) -> DataFrame:
    date = F.lit("2000-01-03").cast("date")
    return q.weekly_negative(t.raw("customer").select(date.alias("date"), F.col("c_nationkey").alias("store_nbr"), (F.col("c_custkey") % 7).alias("item_nbr"), F.col("c_acctbal").alias("unit_sales")), "customers")


_iqr = "(SELECT CASE WHEN q3 > q1 THEN q3 + {k} * (q3 - q1) ELSE q999 END AS bound FROM (SELECT quantile_cont(unit_sales, 0.25) AS q1, quantile_cont(unit_sales, 0.75) AS q3, quantile_cont(unit_sales, 0.999) AS q999 FROM panel))"


@query("i6_high_outliers", ISSUE, _issue("sales", "high_outliers", "info", f"unit_sales > {_iqr.format(k='1.5')}", "panel"))
def _(t: Tables) -> DataFrame:
    return q.high_outliers(t.sales, k=1.5)


@query("d48_iqr_bound", "bound", _iqr.format(k="6")[1:-1])
def _(t: Tables) -> DataFrame:
    return q.iqr_bound(t.sales, "unit_sales")


@query("i7_cardinality", ISSUE, "SELECT 'stores' AS dataset, 'few_store_nbr' AS \"check\", 'warning' AS severity, greatest(54 - count(DISTINCT store_nbr), 0) AS n_affected, count(DISTINCT store_nbr) AS n_rows FROM stores")
def _(t: Tables) -> DataFrame:
    return q.too_few(t.stores(), "stores", "store_nbr", 54)


@query("i8_negative", ISSUE, _issue("customers", "negative_c_acctbal", "warning", "c_acctbal < 0", "customer"))
def _(t: Tables) -> DataFrame:
    return q.negative(t.raw("customer"), "customers", "c_acctbal")


@query("d49_store_coverage", "store_nbr:i coverage", "SELECT store_nbr, count(DISTINCT date) / (SELECT count(DISTINCT date) FROM transactions)::DOUBLE AS coverage FROM transactions GROUP BY store_nbr")
def _(t: Tables) -> DataFrame:
    return q.coverage_by_store(t.transactions())


@query("i8_low_coverage", ISSUE, _issue("transactions", "date_coverage", "warning", "c < 0.99", "(SELECT count(DISTINCT date) / (SELECT count(DISTINCT date) FROM transactions)::DOUBLE AS c FROM transactions GROUP BY store_nbr)"))
def _(t: Tables) -> DataFrame:
    return q.low_coverage(t.transactions(), least=0.99)


@query("i9_missing_oil", ISSUE, _issue("oil", "missing_dcoilwtico", "info", "dcoilwtico IS NULL", "oil"))
def _(t: Tables) -> DataFrame:
    return q.missing_values(t.oil(), "oil", "dcoilwtico")


@query("i10_invalid_locale", ISSUE, _issue("holidays", "invalid_locale", "error", "locale NOT IN ('National', 'Regional', 'Local')", "(SELECT locale FROM panel JOIN holidays USING (date))"))
def _(t: Tables) -> DataFrame:
    return q.invalid_locale(t.sales.select("date").join(t.holidays(), "date"))


@query("c15_unmatched_locales", "date:d locale:s locale_name:s", """
  SELECT date, locale, locale_name FROM h WHERE locale = 'Regional' AND locale_name NOT IN (SELECT state FROM few)
  UNION ALL SELECT date, locale, locale_name FROM h WHERE locale = 'Local' AND locale_name NOT IN (SELECT city FROM few)""".replace(" h ", " holidays ").replace("FROM few", "FROM stores WHERE cluster = 0"))
def _(t: Tables) -> DataFrame:
    return q.unmatched_locales(t.holidays(), t.stores().filter("cluster = 0"))


@query("c14_orphan_keys", "item_nbr:i", "SELECT DISTINCT item_nbr FROM panel WHERE item_nbr NOT IN (SELECT item_nbr FROM items WHERE perishable = 1)")
def _(t: Tables) -> DataFrame:
    return q.orphans(t.sales, t.items().filter("perishable = 1"), "item_nbr")


@query("i11_cross_integrity", ISSUE, _issue("sales", "orphan_item_nbr", "error", "item_nbr % 2 = 0", "(SELECT DISTINCT item_nbr FROM panel)"))
def _(t: Tables) -> DataFrame:
    return q.orphan_issue(t.sales, t.items().filter("perishable = 1"), "sales", "item_nbr")


@query("c1_duplicate_dimension_keys", "n_regionkey:i n:i", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return q.duplicate_samples(t.raw("nation"), ["n_regionkey"], 100).withColumnRenamed("count", "n")


def _audit(t: Tables) -> DataFrame:
    return q.audit(t.sales, t.items(), t.stores(), t.transactions(), t.oil(), t.holidays(), "1992-01-01", "1998-12-31")


_no = "false"
_duplicates = lambda dataset, keys, source: _issue(dataset, "duplicate_keys", "error", "n > 1", f"(SELECT count(*) AS n FROM {source} GROUP BY {keys})")
_few = "SELECT '{0}' AS dataset, 'few_{1}' AS \"check\", 'warning' AS severity, greatest({2} - count(DISTINCT {1}), 0) AS n_affected, count(DISTINCT {1}) AS n_rows FROM {0}"
_orphan = lambda key, source: _issue("sales", f"orphan_{key}", "error", f"{key} NOT IN (SELECT {key} FROM {source})", f"(SELECT DISTINCT {key} FROM panel)")
_checks = [
    "SELECT 'sales' AS dataset, 'columns' AS \"check\", 'error' AS severity, 0 AS n_affected, 5 AS n_rows",
    _issue("sales", "non_numeric_unit_sales", "error", _no, "panel"), _issue("transactions", "non_numeric_transactions", "error", _no, "transactions"), _issue("sales", "not_boolean_onpromotion", "warning", _no, "panel"),
    _duplicates("sales", "date, store_nbr, item_nbr", "panel"), _duplicates("items", "item_nbr", "items"), _duplicates("stores", "store_nbr", "stores"), _duplicates("transactions", "date, store_nbr", "transactions"),
    _issue("sales", "date_range", "warning", "date NOT BETWEEN DATE '1992-01-01' AND DATE '1998-12-31'", "panel"),
    _issue("sales", "weekly_negative", "warning", "s < -1", "(SELECT sum(unit_sales) AS s FROM panel GROUP BY date_trunc('week', date), store_nbr, item_nbr)"),
    _issue("sales", "high_outliers", "info", f"unit_sales > {_iqr.format(k='6')}", "panel"), _few.format("items", "family", 33), _few.format("stores", "store_nbr", 54),
    _issue("transactions", "negative_transactions", "warning", "transactions < 0", "transactions"),
    _issue("transactions", "date_coverage", "warning", "c < 0.9", "(SELECT count(DISTINCT date) / (SELECT count(DISTINCT date) FROM transactions)::DOUBLE AS c FROM transactions GROUP BY store_nbr)"),
    _issue("oil", "missing_dcoilwtico", "info", "dcoilwtico IS NULL", "oil"), _issue("holidays", "invalid_locale", "error", "locale NOT IN ('National', 'Regional', 'Local')", "holidays"),
    _orphan("item_nbr", "items"), _orphan("store_nbr", "stores"),
]


@query("i12_full_audit", ISSUE + " pct", "SELECT *, CASE WHEN n_rows > 0 THEN n_affected / n_rows::DOUBLE ELSE 0 END AS pct FROM (" + " UNION ALL ".join(_checks) + ")")
def _(t: Tables) -> DataFrame:
    return _audit(t)


# H: scalar functions
@query("h1_fourier", "date:d " + " ".join(f"sin_{k} cos_{k}" for k in (1, 2, 3)), "SELECT DISTINCT l_shipdate::DATE AS date, " + ", ".join(
    f"sin({2 * math.pi * k / 365.25!r} * dayofyear(l_shipdate)) AS sin_{k}, cos({2 * math.pi * k / 365.25!r} * dayofyear(l_shipdate)) AS cos_{k}" for k in (1, 2, 3)) + " FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct().withColumns(sc.fourier_terms(F.col("date"), 3))


@query("h2_weekday", "date:d " + " ".join(f"dow_{d}:i" for d in range(1, 7)), "SELECT DISTINCT o_orderdate::DATE AS date, " + ", ".join(f"(isodow(o_orderdate) - 1 = {d})::INT AS dow_{d}" for d in range(1, 7)) + " FROM orders")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().withColumns(sc.weekday_dummies(F.col("date")))


@query("h3_month_position", "date:d is_month_end:i is_month_start:i is_payday:i days_to_month_end:i", """
  SELECT DISTINCT o_orderdate::DATE AS date, (last_day(o_orderdate) = o_orderdate::DATE)::INT AS is_month_end, (day(o_orderdate) <= 3)::INT AS is_month_start,
         (day(o_orderdate) = 15)::INT AS is_payday, (last_day(o_orderdate) - o_orderdate::DATE) AS days_to_month_end FROM orders""")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().withColumns(sc.month_position(F.col("date")))


@query("h4_iso_week", "year_week:s monday:d n:i", "SELECT isoyear(o_orderdate)::VARCHAR || '-' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS year_week, date_trunc('week', o_orderdate) AS monday, count(*) AS n FROM orders GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.raw("orders").groupBy(sc.iso_week(d).alias("year_week"), sc.week_start(d).alias("monday")).agg(F.count("*").alias("n"))


@query("h5_week_start", "monday:d units", "SELECT date_trunc('week', l_shipdate) AS monday, sum(l_quantity) AS units FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy(sc.week_start(F.col("l_shipdate").cast("date")).alias("monday")).agg(F.sum("l_quantity").alias("units"))


@query("h9_link_round_trip", "o_orderkey:i z y", "SELECT o_orderkey, ln(1 + o_totalprice) AS z, o_totalprice AS y FROM orders WHERE o_totalprice < exp(20) - 1")
def _(t: Tables) -> DataFrame:
    o = t.raw("orders").filter(F.col("o_totalprice") < math.exp(20) - 1).withColumn("z", sc.log_link(F.col("o_totalprice")))
    return o.withColumn("y", F.round(sc.exp_link(F.col("z")), 4)).select("o_orderkey", "z", F.round("y", 2).alias("y"))


@query("h12_safe_ratio", "s_suppkey:i ratio", "SELECT s_suppkey, CASE WHEN abs(s_suppkey % 4) >= 1e-8 THEN s_acctbal / (s_suppkey % 4) END AS ratio FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.raw("supplier").select("s_suppkey", sc.safe_ratio(F.col("s_acctbal"), F.col("s_suppkey") % 4).alias("ratio"))


@query("h13_count_target", "event_type:s counts:i", "SELECT event_type, (min(value) >= 0 AND avg((abs(value - round(value)) <= 0.05)::INT) >= 0.9)::INT AS counts FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("event_type").agg(sc.counts_like(F.col("value")).cast("int").alias("counts"))


@query("h14_clip_to_unit", "date:d store_nbr:i item_nbr:i clipped", """
  SELECT date, store_nbr, item_nbr, greatest(least(greatest(unit_sales, m - 1.0 * greatest(s, 1)), m + 1.0 * greatest(s, 1)), 0) AS clipped
  FROM (SELECT *, avg(unit_sales) OVER u AS m, stddev_pop(unit_sales) OVER u AS s FROM panel WINDOW u AS (PARTITION BY store_nbr, item_nbr))""")
def _(t: Tables) -> DataFrame:
    stats = t.sales.groupBy("store_nbr", "item_nbr").agg(F.avg("unit_sales").alias("m"), F.stddev_pop("unit_sales").alias("s"))
    return t.sales.join(stats, ["store_nbr", "item_nbr"]).withColumn("clipped", sc.clip_to_unit(F.col("unit_sales"), F.col("m"), F.col("s"), 1.0))


@query("h15_identifiers", "unit:s episode:s", "SELECT store_nbr || ':' || item_nbr AS unit, store_nbr || '-' || item_nbr || '_' || store_nbr || '-' || class || '_' || t AS episode FROM panel WHERE t = 60")
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.sales.filter("t = 60").select(sc.unit_id(c("store_nbr"), c("item_nbr")).alias("unit"), sc.episode_id(c("store_nbr"), c("item_nbr"), c("store_nbr"), c("class"), c("t")).alias("episode"))


@query("h17_split_reasons", "reason:s n:i", "SELECT trim(r) AS reason, count(*) AS n FROM (SELECT unnest(string_split(o_orderstatus || '; ' || o_orderpriority, ';')) AS r FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    parts = F.transform(F.split(F.concat_ws("; ", "o_orderstatus", "o_orderpriority"), ";"), lambda x: F.trim(x))
    return t.raw("orders").select(F.explode(parts).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("h18_value_masks", "boolean_like:i numeric_like:i n:i", """
  SELECT (lower(trim(x)) IN ('1', 'true', 't', 'yes', 'y', 'si', 'sí', '0', 'false', 'f', 'no', 'n'))::INT AS boolean_like, (TRY_CAST(x AS DOUBLE) IS NOT NULL)::INT AS numeric_like, count(*) AS n
  FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '1.5' WHEN 2 THEN o_orderstatus ELSE '0' END AS x FROM orders) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, "Yes").when(k == 1, "1.5").when(k == 2, F.col("o_orderstatus")).otherwise("0")
    return t.raw("orders").groupBy(sc.is_boolean_like(x).cast("int").alias("boolean_like"), sc.is_numeric_like(x).cast("int").alias("numeric_like")).agg(F.count("*").alias("n"))


@query("h19_json", "store_nbr:i params:s", "SELECT store_nbr, '{\"city\":\"' || city || '\",\"cluster\":' || cluster || '}' AS params FROM stores")
def _(t: Tables) -> DataFrame:
    return t.stores().select("store_nbr", F.to_json(F.struct("city", "cluster")).alias("params"))


# E1-E8: exposure and runs
EXPOSED = "date:d store_nbr:i item_nbr:i class:i H_prop_raw H_disc:i H_bin:i"


@query("e1_competitive_exposure", EXPOSED, "SELECT * FROM exposure")
def _(t: Tables) -> DataFrame:
    return t.exposed


@query("e1_exposure_with_self", EXPOSED, """
  SELECT *, H_disc / n::DOUBLE AS H_prop_raw, (H_disc / n::DOUBLE >= 0.02)::INT AS H_bin
  FROM (SELECT *, count(*) OVER g AS n, (sum(onpromotion) OVER g)::INT AS H_disc FROM panel WINDOW g AS (PARTITION BY date, store_nbr, class))""")
def _(t: Tables) -> DataFrame:
    return ex.exposure(t.sales, include_self=True)


CTES["class_loo"] = """
  SELECT *, CASE WHEN c - (H_prop_raw IS NOT NULL)::INT > 0 THEN (s - coalesce(H_prop_raw, 0)) / (c - (H_prop_raw IS NOT NULL)::INT) END AS H_class_loo
  FROM (SELECT *, count(H_prop_raw) OVER g AS c, coalesce(sum(H_prop_raw) OVER g, 0) AS s FROM exposure WINDOW g AS (PARTITION BY date, store_nbr, class))"""


@query("e2_class_mean_without", "date:d store_nbr:i item_nbr:i H_class_loo", "SELECT * FROM class_loo")
def _(t: Tables) -> DataFrame:
    return ex.class_mean_without(t.exposed)


CTES["series"] = "SELECT store_nbr, item_nbr, t, H_prop_raw AS x, row_number() OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) AS k FROM exposure"
CTES["ema"] = """
  SELECT store_nbr, item_nbr, t, k, x AS y, 1.0::DOUBLE AS w FROM series WHERE k = 1
  UNION ALL
  SELECT s.store_nbr, s.item_nbr, s.t, s.k,
         CASE WHEN s.x IS NULL THEN e.y WHEN e.y IS NULL THEN s.x ELSE (e.w * 0.75 * e.y + 0.25 * s.x) / (e.w * 0.75 + 0.25) END,
         CASE WHEN s.x IS NULL AND e.y IS NOT NULL THEN e.w * 0.75 ELSE 1.0 END
  FROM ema e JOIN series s ON s.store_nbr = e.store_nbr AND s.item_nbr = e.item_nbr AND s.k = e.k + 1"""


@query("e3_ema", "store_nbr:i item_nbr:i t:i H_prop", "SELECT *, y AS H_prop FROM ema")
def _(t: Tables) -> DataFrame:
    return ex.ema(t.exposed.select("store_nbr", "item_nbr", "t", "H_prop_raw"), "H_prop_raw", "H_prop", ex.ema_alpha(span=t.cfg.ema_span))


@query("e3_ema_of_long_series", "event_type:s event_id:i mean", """
  SELECT event_type, event_id, list_sum(list_transform(xs, lambda x, i: x * pow(0.75, len(xs) - i) * CASE WHEN i = 1 AND k = len(xs) THEN 1.0 ELSE 0.25 END)) AS mean
  FROM (SELECT event_type, event_id, list(value) OVER (o ROWS 199 PRECEDING) AS xs, row_number() OVER o AS k
        FROM events WHERE value IS NOT NULL WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id))""")
def _(t: Tables) -> DataFrame:
    # a type's events are one series; in the SQL what is older than 200 events weighs less than 1e-24
    events = t.raw("events").filter("value IS NOT NULL").select("event_type", "ts", "event_id", "value")
    return ex.ema_of_long_series(events, "value", "mean", 0.25, "ts", ["event_type"])


@query("e3_trailing_mean", "store_nbr:i item_nbr:i t:i H_prop", "SELECT *, avg(H_prop_raw) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t ROWS 6 PRECEDING) AS H_prop FROM exposure")
def _(t: Tables) -> DataFrame:
    return ex.trailing_mean(t.exposed, "H_prop_raw", "H_prop", 7)


@query("e4_winsorise", "store_nbr:i item_nbr:i t:i H_win", """
  SELECT store_nbr, item_nbr, t, CASE WHEN H_prop_raw IS NOT NULL THEN least(greatest(H_prop_raw, coalesce(CASE WHEN m >= 30 THEN lo END, glo)), coalesce(CASE WHEN m >= 30 THEN hi END, ghi)) END AS H_win
  FROM exposure LEFT JOIN (SELECT store_nbr, class, count(H_prop_raw) AS m, quantile_cont(H_prop_raw, 0.05) AS lo, quantile_cont(H_prop_raw, 0.95) AS hi FROM exposure GROUP BY ALL) USING (store_nbr, class),
       (SELECT quantile_cont(H_prop_raw, 0.05) AS glo, quantile_cont(H_prop_raw, 0.95) AS ghi FROM exposure)""")
def _(t: Tables) -> DataFrame:
    return ex.winsorise(t.exposed, "H_prop_raw", "H_win", ["store_nbr", "class"], 0.05, 0.95)


@query("c18_group_quantiles", "class:i t:i store_nbr:i item_nbr:i capped", """
  SELECT class, t, store_nbr, item_nbr, least(greatest(unit_sales, lo), hi) AS capped FROM panel JOIN
  (SELECT class, quantile_cont(unit_sales, 0.01) AS lo, quantile_cont(unit_sales, 0.99) AS hi FROM panel GROUP BY class) USING (class)""")
def _(t: Tables) -> DataFrame:
    return ex.winsorise(t.sales, "unit_sales", "capped", ["class"], 0.01, 0.99)


@query("e5_runs", "store_nbr:i item_nbr:i run_start:i run_end:i n:i", "SELECT * FROM runs")
def _(t: Tables) -> DataFrame:
    return t.found_runs


@query("e6_run_lengths", "n:i runs:i", "SELECT n, count(*) AS runs FROM runs GROUP BY n")
def _(t: Tables) -> DataFrame:
    return rn.run_lengths(t.found_runs)


@query("e7_gap_runs", "store_nbr:i item_nbr:i run_start:i run_end:i n:i", """
  SELECT store_nbr, item_nbr, min(t) AS run_start, max(t) AS run_end, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) AS run FROM (
      SELECT *, coalesce((t - lag(t) OVER (PARTITION BY store_nbr, item_nbr ORDER BY t) > 2)::INT, 1) AS new FROM panel WHERE onpromotion = 1))
  GROUP BY store_nbr, item_nbr, run HAVING max(t) - min(t) + 1 >= 2""")
def _(t: Tables) -> DataFrame:
    return rn.gap_runs(t.sales, 2, 1)


CTES["masked"] = "SELECT e.*, (r.n IS NOT NULL)::INT AS in_run FROM exposure e LEFT JOIN runs r ON e.store_nbr = r.store_nbr AND e.item_nbr = r.item_nbr AND e.t BETWEEN run_start AND run_end"


@query("e8_run_mask", "store_nbr:i item_nbr:i t:i in_run:i", "SELECT * FROM masked")
def _(t: Tables) -> DataFrame:
    return rn.run_mask(t.exposed, t.found_runs)


@query("c2_neighbourhood_join", "date:d store_nbr:i item_nbr:i family:s", "SELECT date, store_nbr, item_nbr, family FROM panel JOIN items USING (item_nbr)")
def _(t: Tables) -> DataFrame:
    return t.sales.drop("class").join(t.items(), "item_nbr", "left")


# D33-D36: exposure summaries
@query("d33_exposure_summary", "n:i mean sd min max zero_share", "SELECT count(x) AS n, avg(x) AS mean, stddev_pop(x) AS sd, min(x) AS min, max(x) AS max, avg((x = 0)::INT) AS zero_share FROM (SELECT H_prop_raw AS x FROM exposure)")
def _(t: Tables) -> DataFrame:
    return ex.exposure_summary(t.exposed)


@query("d33_exposure_histogram", "bin:i n:i share cdf", """
  SELECT bin, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf
  FROM (SELECT least(floor(H_prop_raw * 20), 19)::INT AS bin, count(*) AS n FROM exposure WHERE H_prop_raw IS NOT NULL GROUP BY 1)""")
def _(t: Tables) -> DataFrame:
    return ex.histogram(t.exposed, "H_prop_raw")


@query("d34_exposure_by_date", "date:d n:i mean zero_share", "SELECT date, count(H_prop_raw) AS n, avg(H_prop_raw) AS mean, avg((H_prop_raw = 0)::INT) AS zero_share FROM exposure GROUP BY date")
def _(t: Tables) -> DataFrame:
    return ex.by_date(t.exposed)


@query("d35_exposure_by_store", "store_nbr:i n:i mean", "SELECT store_nbr, count(H_prop_raw) AS n, avg(H_prop_raw) AS mean FROM exposure GROUP BY store_nbr")
def _(t: Tables) -> DataFrame:
    return ex.by_store(t.exposed)


@query("d36_date_store_matrix", "date:d place:i store_nbr:i mean", """
  WITH top AS MATERIALIZED (SELECT store_nbr FROM (SELECT store_nbr, count(H_prop_raw) AS n, avg(H_prop_raw) AS m FROM exposure GROUP BY 1 HAVING count(H_prop_raw) >= 1 ORDER BY n DESC, m DESC, store_nbr LIMIT 10)),
  daily AS MATERIALIZED (SELECT date, store_nbr, avg(H_prop_raw) AS mean FROM exposure JOIN top USING (store_nbr) GROUP BY ALL)
  SELECT date, place, store_nbr, mean FROM daily JOIN (SELECT store_nbr, row_number() OVER (ORDER BY avg(mean) DESC, store_nbr) AS place FROM daily GROUP BY 1) USING (store_nbr) WHERE mean IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """The matrix of the ten largest stores, with each column's place and store beside its values."""
    stores = ex.matrix_stores(t.exposed, 10)
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("store_nbr"), F.col(f"store_{s}").alias("mean")) for i, s in enumerate(stores, 1)])
    return ex.date_store_matrix(t.exposed, stores).select("date", F.explode(cells).alias("x")).select("date", "x.*").filter("mean IS NOT NULL")


@query("f15_top_stores", "store_nbr:i n:i mean", "SELECT store_nbr, count(H_prop_raw) AS n, avg(H_prop_raw) AS mean FROM exposure GROUP BY 1 HAVING count(H_prop_raw) >= 30 ORDER BY n DESC, mean DESC, store_nbr LIMIT 10")
def _(t: Tables) -> DataFrame:
    return ex.top_stores(t.exposed, 10)
