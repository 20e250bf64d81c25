"""Named queries: each is (spark, sf_dir) -> DataFrame plus an optional oracle SQL.

The oracle text is plain SQL over the same fixture views (defined by the shared
fixture SQL), runnable by DuckDB; queries that SQL cannot express carry None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from carelake.sources.fixtures import oracle_with


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, ops: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, ops)
        return fn
    return deco


def sql(views: tuple[str, ...], body: str, extra_ctes: str = "") -> str:
    """Oracle text: fixture CTEs, optional extra CTEs (``name AS (...)``), then the body."""
    head = oracle_with(*views)
    if extra_ctes:
        head = head.rstrip() + ",\n" + extra_ctes.strip() + "\n"
    return head + body.strip()
