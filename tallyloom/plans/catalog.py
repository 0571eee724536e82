"""All registered queries in one place."""

from __future__ import annotations

import importlib
import pkgutil

from .. import plans
from .flagship import flagship
from .registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")):
    importlib.import_module(f"{plans.__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES", "flagship"]
