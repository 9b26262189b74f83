"""Registered queries over the test tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscope.operators import composed, embedding, evaluation, frames, ranking, statistics, texts, zipf
from corpuscope.plans.dialect import DUCK, SPARK
from corpuscope.plans.relations import duck, spark_sql


def _sql() -> dict[str, tuple[Callable, Callable]]:
    """name -> (query by dialect, relations by dialect that come before it)."""
    out: dict[str, tuple[Callable, Callable]] = {}
    for module in (texts, statistics, ranking, evaluation, zipf, embedding, composed):
        relations = getattr(module, "relations", lambda d: [])
        for name, q in module.QUERIES.items():
            out[name] = (q, relations)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: (lambda spark, sf_dir, q=q, r=r: spark_sql(spark, sf_dir, q(SPARK), r(SPARK))) for n, (q, r) in _sql().items()}
    return out | frames.FRAMES


def oracle_sql() -> dict[str, str]:
    return {n: duck(q(DUCK), r(DUCK)) for n, (q, r) in _sql().items()} | frames.oracle_sql()
