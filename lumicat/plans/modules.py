"""Imports the query modules once, so that they register themselves."""

import importlib

NAMES: list[str] = ["scalars", "relational", "aggregates", "topics", "ranking", "incremental", "nlu", "documents", "sources", "extras"]


def load() -> None:
    for name in NAMES:
        importlib.import_module(f"lumicat.plans.{name}")
