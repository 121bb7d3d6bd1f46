"""All queries of the usage-log engine by name, and their SQL."""

from __future__ import annotations

from .plans import accounting, generations, logs, raw, usage

QUERIES = {**usage.QUERIES, **accounting.QUERIES, **logs.QUERIES, **generations.QUERIES, **raw.QUERIES}
ORACLES: dict[str, str] = {**usage.ORACLES, **accounting.ORACLES, **logs.ORACLES, **generations.ORACLES, **raw.ORACLES}
