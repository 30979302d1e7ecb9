"""Registered queries over the driver tables, one module per operator group."""

from __future__ import annotations

import importlib
import pkgutil

from daygrid.catalog.base import ORACLES, QUERIES


def load():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__) if x.name != "base"):
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
