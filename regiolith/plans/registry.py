"""All queries of the library with their oracles.

A query is a function of the session and a folder of tables; its oracle is SQL for the same rows. Views that
several oracles read are named in ``views`` and put in front of them.
"""

from __future__ import annotations

import importlib
import importlib.util
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regiolith.plans.views import VIEWS

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("text", "cleaning", "matching", "sources", "geo", "aggregates", "windows", "scores", "clusters", "projections", "learning", "streams", "reports", "portfolio", "strategy", "advice")


def query(name: str, oracle: str | None = None):
    """Registers the decorated function, and its SQL if there is one."""

    def add(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = with_views(oracle)
        return fn

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is already registered, with its views, for use inside another one."""
    return _ORACLES[name]


def with_views(sql: str) -> str:
    """The SQL with the views it names, and those that they name, in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    parts = [f"{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n]).strip()})" for n in needed]
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return "with recursive " + ", ".join([*parts, body[15:]])
    if body[:5].lower() == "with ":
        return "with " + ", ".join([*parts, body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


def load() -> None:
    for name in MODULES:
        if importlib.util.find_spec(f"regiolith.plans.{name}"):
            importlib.import_module(f"regiolith.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    from regiolith.plans.flow import ranked_communities

    return ranked_communities(spark, sf_dir, smallest=3)
