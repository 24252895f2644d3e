"""Every operator run over the test tables, with the SQL it must agree with.

The test tables are no geodata, so each module first states the analogue it uses: which columns play
the events, the grid, the soil survey or the raster. Both sides share that statement.
"""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "profile", "weather", "rainfall", "climate", "soil", "terrain", "ranking", "scoring", "models", "jobs", "workflow",
]


def _merged(attribute: str) -> dict:
    merged = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
