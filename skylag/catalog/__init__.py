"""Every operator run over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from skylag.catalog import (  # noqa: F401  (importing a module registers its queries)
    calendars,
    causes_and_rates,
    models,
    profiles,
    propagation,
    reports,
    scalars,
    selections,
    tables,
    weather,
)
from skylag.catalog.registry import ORACLES, QUERIES  # noqa: F401
