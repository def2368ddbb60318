"""Every registered query of the library proper and its DuckDB SQL."""

from __future__ import annotations

from kinetrace.plans import contracts, frames, language, records, rules, summaries, telemetry

MODULES = (telemetry, frames, language, rules, contracts, records, summaries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
