"""Collects the library's queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("plans.listing", "plans.facts_views", "plans.series", "plans.urls", "plans.text", "plans.rules", "plans.links", "plans.contents", "plans.models", "plans.pages", "streaming.events", "streaming.monitor")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"quern.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"quern.{name}").SQL)
    return out
