"""All queries of the library proper."""

from __future__ import annotations

from . import backtests, base, cleaning, evidence, feature_plans, incremental, scoring, serving, signals

QUERIES, ORACLES = base.QUERIES, base.ORACLES
MODULES = (backtests, cleaning, evidence, feature_plans, incremental, scoring, serving, signals)
