"""Registered queries, grouped like the operator inventory."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every query module of this package once; importing registers its queries."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
