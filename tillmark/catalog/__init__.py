"""Named queries bound to the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from tillmark.catalog.base import CHECKS, QUERIES, check_sql


def load() -> dict:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(QUERIES)


def checks() -> dict[str, str]:
    load()
    return {name: check_sql(needs, body) for name, (needs, body) in CHECKS.items()}
