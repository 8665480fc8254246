"""Named queries over the landed tables, and the jobs that write whole runs."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def QUERIES_AND_ORACLES():  # noqa: N802
    """All registered queries and their SQL, in the order of the modules below."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
    from linegrain.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
