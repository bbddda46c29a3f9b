"""Registered queries: one per SURVEY §2 operator, each over whole fixture
views of the driver's tables, plus the DuckDB SQL that computes the same
rows. Keys are ``<survey id>_<operator>``.

Doubles are rounded to 6 places on both sides so engine-specific summation
order cannot flip the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


# Import modules that register queries (order = survey order).
from starlens.plans import q_digest  # noqa: E402,F401
from starlens.plans import q_dashboard  # noqa: E402,F401
from starlens.plans import q_audit  # noqa: E402,F401
from starlens.plans import q_eval  # noqa: E402,F401
from starlens.plans import q_text  # noqa: E402,F401
from starlens.plans import q_models  # noqa: E402,F401
from starlens.plans import q_context  # noqa: E402,F401
from starlens.plans import q_stream  # noqa: E402,F401
from starlens.plans import q_misc  # noqa: E402,F401
from starlens.plans import q_sources  # noqa: E402,F401
