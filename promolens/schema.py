"""Column names, parameters and driver-side schema checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = ["store_nbr", "item_nbr"]

PANEL = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("store_nbr", T.IntegerType()),
        T.StructField("item_nbr", T.IntegerType()),
        T.StructField("unit_sales", T.DoubleType()),
        T.StructField("onpromotion", T.StringType()),
    ]
)
ITEMS = T.StructType([T.StructField("item_nbr", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("class", T.IntegerType()), T.StructField("perishable", T.IntegerType())])
STORES = T.StructType([T.StructField("store_nbr", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("city", "state", "type")], T.StructField("cluster", T.IntegerType())])
TRANSACTIONS = T.StructType([T.StructField("date", T.DateType()), T.StructField("store_nbr", T.IntegerType()), T.StructField("transactions", T.StringType())])
OIL = T.StructType([T.StructField("date", T.DateType()), T.StructField("dcoilwtico", T.DoubleType())])
HOLIDAYS = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.StringType()) for c in ("type", "locale", "locale_name", "description")], T.StructField("transferred", T.BooleanType())])


@dataclass(frozen=True)
class Config:
    """Thresholds and window lengths; windows count periods of the integer time column t.

    Fixed values: the defaults are those of daily panels. `monthly()` fits the month panel of the test
    tables: its windows and thresholds, and fewer cannibals and victims, each with a fit of its own.
    """

    bin_threshold: float = 0.02
    ema_span: float = 7
    winsor: tuple[float, float] = (0.005, 0.995)
    winsor_min_obs: int = 30
    window: tuple[int, int] = (16801, 17347)  # days since 1970 of 2016-01-01 and 2017-06-30
    min_run: int = 3
    min_item_obs: int = 200
    h_sd_min: float = 0.004
    p_any: tuple[float, float] = (0.02, 0.98)
    p_promo_i: tuple[float, float] = (0.03, 0.25)
    p_promo_j_max: float = 0.10
    top_cannibals: int = 100
    top_victims: int = 50
    pre: int = 90
    gap: int = 7
    treat_max: int = 14
    post: int = 30
    pre_coverage: float = 0.60
    pre_sd_min: float = 0.003
    pre_mean_min: float = 0.01
    pre_zero_max: float = 0.30
    pre_cv_max: float = 1.25
    donors: int = 10
    donor_preselect: int = 120
    donor_coverage: float = 0.55
    donor_alpha: float = 0.5
    donor_promo_max: float = 0.02
    donor_avail_min: float = 0.90
    lags: tuple[int, ...] = (7, 14, 28, 56)
    fourier: int = 3

    @staticmethod
    def monthly() -> Config:
        return Config(
            window=(53, 107), min_run=2, min_item_obs=20, p_promo_j_max=0.16, top_cannibals=40, top_victims=5, pre=12, gap=1,
            treat_max=3, post=6, pre_coverage=0.40, pre_zero_max=0.80, pre_cv_max=3.0, donor_coverage=0.40,
            donor_promo_max=0.20, donor_avail_min=0.40, lags=(1, 2, 3, 6),
        )


def require_columns(df: DataFrame, required: list[str], name: str = "table") -> DataFrame:
    """df, or a ValueError that lists the columns it lacks. Reads the schema only."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df


def first_existing(df: DataFrame, *names: str) -> str | None:
    """The first of several synonyms that df has."""
    return next((n for n in names if n in df.columns), None)


def rename_synonyms(df: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with the first existing synonym of each missing column renamed to it."""
    for name, others in synonyms.items():
        if name not in df.columns and (found := first_existing(df, *others)):
            df = df.withColumnRenamed(found, name)
    return df


def ensure_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with absent columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def cast_existing(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value everywhere here; Spark would order and average it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def safe_features(df: DataFrame, blocked: set[str], blocked_prefixes: tuple[str, ...] = (), allowed: set[str] | None = None) -> list[str]:
    """Numeric columns that may be used as features: not blocked by name or prefix, or in the allow-list."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType | T.BooleanType)]
    return [c for c in numeric if (allowed is None or c in allowed) and c not in blocked and not c.startswith(blocked_prefixes or ("\0",))]


def pick_treatment(df: DataFrame, wanted: str, fallback: str = "D") -> Column:
    return F.col(wanted if wanted in df.columns else fallback)
