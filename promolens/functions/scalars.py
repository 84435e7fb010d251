"""Scalar column functions: flags, dates, links, distances, identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of true in text flags.
TRUE_LIKE = ("1", "true", "t", "yes", "y", "si", "sí")
#: Spellings of false; any other text counts as true under the text rule.
FALSE_LIKE = ("", "0", "false", "f", "no", "n", "nan", "none", "null", "na")


def promo_flag(c: Column, rule: str = "text") -> Column:
    """0/1 of a promotion flag. Rules: `text` (any text not listed as false is true), `numeric` (numbers
    clipped to 0..1 and cut to an integer, else true, t, 1 or yes), `clip` (numbers only, else 0)."""
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    clipped = F.least(F.greatest(F.when(F.isnan(number), F.lit(0.0)).otherwise(number), F.lit(0.0)), F.lit(1.0)).cast("int")
    if rule == "text":
        return F.when(text.isNull() | text.isin(*FALSE_LIKE), 0).otherwise(1)
    if rule == "numeric":
        return F.coalesce(clipped, text.isin("true", "t", "1", "yes").cast("int"), F.lit(0))
    if rule == "clip":
        return F.coalesce(clipped, F.lit(0))
    raise ValueError(f"unknown rule {rule}")


def is_boolean_like(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin(*TRUE_LIKE, "0", "false", "f", "no", "n")


def is_numeric_like(c: Column) -> Column:
    return c.cast("string").try_cast("double").isNotNull()


def lenient_date(c: Column) -> Column:
    return F.try_to_date(c.cast("string"), "yyyy-MM-dd")


def non_negative(c: Column) -> Column:
    """Nulls and negatives become 0."""
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def fourier_terms(date: Column, order: int = 3, year: float = 365.25) -> dict[str, Column]:
    day = F.dayofyear(date)
    out = {}
    for k in range(1, order + 1):
        out[f"sin_{k}"] = F.sin(F.lit(2 * math.pi * k / year) * day)
        out[f"cos_{k}"] = F.cos(F.lit(2 * math.pi * k / year) * day)
    return out


def weekday_dummies(date: Column) -> dict[str, Column]:
    """0/1 for Tuesday (1) to Sunday (6); Monday is the base."""
    return {f"dow_{d}": (F.weekday(date) == d).cast("int") for d in range(1, 7)}


def month_position(date: Column) -> dict[str, Column]:
    day = F.dayofmonth(date)
    return {
        "is_month_end": (F.last_day(date) == date).cast("int"),
        "is_month_start": (day <= 3).cast("int"),
        "is_payday": (day == 15).cast("int"),
        "days_to_month_end": F.datediff(F.last_day(date), date),
    }


def iso_week(date: Column) -> Column:
    return F.format_string("%d-%02d", F.extract(F.lit("YEAROFWEEK"), date), F.extract(F.lit("WEEK"), date))


def week_start(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


def month_index(date: Column, origin: int = 1992) -> Column:
    return ((F.year(date) - origin) * 12 + F.month(date) - 1).cast("int")


def day_index(date: Column) -> Column:
    return F.unix_date(date)


def log_link(y: Column) -> Column:
    return F.log1p(F.greatest(y, F.lit(-1 + 1e-9)))


def exp_link(z: Column) -> Column:
    return F.greatest(F.expm1(F.least(F.greatest(z, F.lit(-20.0)), F.lit(20.0))), F.lit(0.0))


def safe_ratio(a: Column, b: Column, least: float = 1e-8) -> Column:
    """a / b, null where b is nearly 0."""
    return F.when(F.abs(b) >= least, a / b)


def profile_distance(mean: Column, sd: Column, p: Column) -> Column:
    """Weighted distance of two profiles, from the differences of their mean, spread and share."""
    return F.sqrt(0.5 * mean * mean + 0.2 * sd * sd + 0.3 * p * p)


def donor_side(donor: Column, victim: Column) -> Column:
    return F.when(donor >= victim, F.lit("above")).otherwise(F.lit("below"))


def donor_score(donor: Column, victim: Column, distance: Column, alpha: float = 0.5) -> Column:
    """alpha x relative level gap + (1 - alpha) x distance, 15 % less inside half the victim's level."""
    gap = F.abs(donor - victim) / F.greatest(F.abs(victim), F.lit(1e-6))
    score = alpha * gap + (1 - alpha) * distance
    return F.when(gap <= 0.5, score * 0.85).otherwise(score)


def counts_like(x: Column, near: float = 0.05, share: float = 0.9) -> Column:
    """As an aggregate: whether values are never negative and nearly all whole."""
    return (F.min(x) >= 0) & (F.avg((F.abs(x - F.round(x)) <= near).cast("int")) >= share)


def clip_to_unit(x: Column, mean: Column, sd: Column, width: float = 3.5) -> Column:
    """x within mean +- width x max(sd, 1), and not below 0."""
    half = width * F.greatest(F.coalesce(sd, F.lit(1.0)), F.lit(1.0))
    return F.greatest(F.least(F.greatest(x, mean - half), mean + half), F.lit(0.0))


def unit_id(store: Column, item: Column) -> Column:
    return F.concat_ws(":", store, item)


def episode_id(i_store: Column, i_item: Column, j_store: Column, j_item: Column, treat_start: Column) -> Column:
    return F.concat(i_store.cast("string"), F.lit("-"), i_item.cast("string"), F.lit("_"), j_store.cast("string"), F.lit("-"), j_item.cast("string"), F.lit("_"), treat_start.cast("string"))


def model_label(c: Column) -> Column:
    """One spelling of estimator names: GSC, S, T, X or the upper-cased text."""
    text = F.lower(F.trim(c))
    return F.when(text.startswith("gsc") | text.startswith("synth"), "GSC").when(text.rlike(r"(^|[_-])[stx](-?learner)?$"), F.upper(F.regexp_extract(text, r"([stx])(-?learner)?$", 1))).otherwise(F.upper(text))


def hash_order(seed: int, *keys: Column) -> Column:
    """A key that puts rows in a random order, the same in any engine."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))
