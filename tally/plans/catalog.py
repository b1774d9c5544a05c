"""Registered queries: one Spark plan per operator, each with its SQL twin.

Every query reads whole given tables (or tables Spark derives from them by
rule).  Floating-point outputs are rounded to 9 significant digits on both
sides (``finalize`` / ``finalize_sql``) because aggregation order differs
between engines.  Queries without an SQL twin are checked by row count in
the driver and by invariants in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tally.functions.stats import finalize, finalize_sql


@dataclass(frozen=True)
class Registered:
    build: Callable[[SparkSession, str], DataFrame]   # plan + rounding for the oracle hash
    sql: str | None
    raw: Callable[[SparkSession, str], DataFrame]     # the operator plan itself (bench)


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None, doubles: Sequence[str] = (),
             digits: int = 9) -> Callable:
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf: str, _fn=fn) -> DataFrame:
            return finalize(_fn(spark, sf), digits)

        build.__name__ = f"q_{name}"
        REGISTRY[name] = Registered(build, finalize_sql(sql, doubles, digits) if sql else None, fn)
        return fn
    return deco


def load_all() -> dict[str, Registered]:
    # importing the modules fills REGISTRY
    from tally.plans import (  # noqa: F401
        q_charts,
        q_clean,
        q_cluster,
        q_evaluate,
        q_missing,
        q_planted,
        q_profile,
        q_regress,
        q_sources,
        q_timeseries,
    )
    return REGISTRY
