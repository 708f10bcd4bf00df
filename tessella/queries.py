"""Registry of the engine's own queries: name, Spark callable and the DuckDB SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries through ``QUERIES`` (name -> callable) and ``ORACLES`` (name -> SQL).
MODULES = ("tessella.plans.corpus", "tessella.plans.scalars", "tessella.plans.relational", "tessella.plans.knowledge", "tessella.plans.facts", "tessella.plans.views", "tessella.plans.stored")


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in import_module(m).ORACLES.items()}
