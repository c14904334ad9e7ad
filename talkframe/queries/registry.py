"""Every query: one Spark function and, where SQL can say it, the SQL text it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkframe import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def over_signals(body: str) -> str:
    """SQL whose first view is ``signals``; ``body`` continues the WITH list or is the final select."""
    return f"with recursive {views.SIGNALS_SQL}{_join(body)}"


def over_messages(body: str) -> str:
    return f"with recursive {views.MESSAGES_SQL}{_join(body)}"


def _join(body: str) -> str:
    text = body.strip()
    return "\n" + text if text.lower().startswith("select") else ",\n" + text
