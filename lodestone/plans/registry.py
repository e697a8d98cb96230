"""The modules whose queries are registered."""

from __future__ import annotations

from lodestone.plans import catalog, general, jobs, learning, retrieval, search, streams, telemetry

FLAGSHIP = telemetry.access_window_aggregate


def modules() -> list:
    return [general, catalog, telemetry, retrieval, search, jobs, learning, streams]
