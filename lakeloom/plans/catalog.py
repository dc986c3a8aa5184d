"""Registered queries: each name has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.functions import own
from lakeloom.plans import advanced, changing, functions, relational, relations, scalars, scripts, star, statistics, windows
from lakeloom.sources import formats
from lakeloom.streaming import events, states, timers

_MODULES = (advanced, changing, functions, relational, star, statistics, windows, relations, scalars, scripts, own, formats, events, states, timers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
