"""All registered queries."""

import importlib
import pkgutil

from firmlens.catalog.base import REGISTRY

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["REGISTRY"]
