"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

from pagelore.plans.base import ORACLES, QUERIES

MODULES = ("access_queries", "cost_queries", "model_queries", "report_queries", "file_queries", "experiments")
for _m in MODULES:
    import_module(f"pagelore.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
