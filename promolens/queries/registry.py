"""Registry of queries: a DataFrame builder, result columns and, where it exists, equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.queries.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Common table expressions that queries' SQL may name.
CTES: dict[str, str] = {}

_SPARK = {"i": lambda c: c.cast("long"), "s": lambda c: c.cast("string"), "f": lambda c: F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0), "d": lambda c: c.cast("date").cast("string")}
_SQL = {"i": '"{0}"::BIGINT AS "{0}"', "s": '"{0}"::VARCHAR AS "{0}"', "f": 'round("{0}"::DOUBLE + 1e-9, 6) + 0.0 AS "{0}"', "d": '"{0}"::DATE::VARCHAR AS "{0}"'}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) if ":" in x else (x, "f") for x in spec.split()]


def with_ctes(body: str) -> str:
    """body under a WITH clause of the expressions it names, and of those that they name."""
    needed: list[str] = []
    seen: set[str] = set()

    def named(name: str, text: str) -> bool:
        return bool(re.search(rf"\b(FROM|JOIN)\s+{name}\b", text))

    def visit(text: str) -> None:
        for name in CTES:
            if name not in seen and named(name, text):
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(body)
    loops = {n for n in needed if named(n, CTES[n])}
    recursive = bool(loops)
    # each is computed once, however often it is named
    head = ", ".join(f"{n} AS {'' if n in loops else 'MATERIALIZED '}({CTES[n].strip()})" for n in needed)
    return f"WITH {'RECURSIVE ' * recursive}{head} {body}" if needed else body


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of Tables. `columns` lists name:kind with kind i, s, d or f (the default); doubles
    are rounded to 6 places, a little above halves so that both engines round those alike, and dates are text, in Spark and in SQL alike."""
    cols = _columns(columns)

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            return df.select(*[_SPARK[k](F.col(c)).alias(c) for c, k in cols])

        QUERIES[name] = run
        if sql:
            SQL[name] = with_ctes(f"SELECT {', '.join(_SQL[k].format(c) for c, k in cols)} FROM ({sql.strip()}) AS result")
        return build

    return register
