"""The register of queries: a function (spark, sf_dir) -> DataFrame and, where SQL can say it, independent oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trivane.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = with_views(oracle)
        return f

    return register
