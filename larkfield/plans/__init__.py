"""Named queries over the driver tables and the SQL they must equal."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
