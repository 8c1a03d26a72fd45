"""Registered queries: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from .views import Views, sql

SPARK: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *ctes: str):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its SQL."""

    def add(fn):
        assert name not in SPARK, name
        SPARK[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if body is not None:
            SQL[name] = sql(body, *ctes)
        return fn

    return add
