"""Registration of queries with their SQL, and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def round_many(c: str) -> Column:
    """``F.round`` to six digits, the same to the bit, without its decimals wherever no rounding of doubles can matter."""
    scaled = F.col(c) * F.lit(10.0**DIGITS)
    plain = (F.abs(c) < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.rint(scaled) / F.lit(10.0**DIGITS)).otherwise(F.round(c, DIGITS))


def rounded(df: DataFrame, many: bool = False) -> DataFrame:
    """Doubles to six digits; the added zero turns -0.0 into 0.0."""
    digits = round_many if many else lambda c: F.round(c, DIGITS)
    return df.select(*[(digits(c) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", many: bool = False):
    """Register a query; ``doubles`` names the columns of ``sql`` to round alike. With ``many`` rows, rounding is by ``round_many``."""

    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir), many)
        if sql is not None:
            replaced = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if replaced else sql
        return function

    return register
