"""The registered queries: each module applies operators to the given tables and states the same in SQL."""

from __future__ import annotations

import importlib
import pkgutil

from ..registry import ORACLES, QUERIES


def load_all():
    """Import every module of this package once; (queries, SQL by name)."""
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
    return QUERIES, ORACLES
