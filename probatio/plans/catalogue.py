"""All registered queries of the engine, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that register queries; each has QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("invoices", "files", "structures", "pixels", "pdfs", "scores")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"probatio.plans.{name}"), attribute))
    return found


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
