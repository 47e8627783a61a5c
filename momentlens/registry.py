"""Every query of the library and its SQL, by name."""

from __future__ import annotations

from momentlens.queries import frame_queries, interval_queries, media_queries, report_queries, series_queries, stream_queries

FLAGSHIP = "t01_top_moments"
_MODULES = (series_queries, interval_queries, media_queries, frame_queries, report_queries, stream_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
