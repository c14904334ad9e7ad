"""Registered queries, grouped by operator family."""

from importlib import import_module

GROUPS = ["ordered", "context", "evidence", "aggregates", "evaluation", "auditing", "sources", "learning", "live", "reports"]


def load() -> None:
    for group in GROUPS:
        import_module(f"talkframe.queries.{group}")
