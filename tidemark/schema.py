"""Schemas of the stored tables. Every timestamp is a UTC instant; `extra` is JSON text."""

from __future__ import annotations

READINGS = "id bigint, series string, ts timestamp, value double, unit string, source string, extra string"
HEADLINES = (
    "url string, domain string, source string, published_at timestamp, first_seen timestamp, "
    "title string, summary string, keywords array<string>"
)
SOURCE_RUNS = (
    "run_id string, source string, ok boolean, error string, n_readings bigint, "
    "n_headlines bigint, n_notes bigint, fetched_at timestamp"
)
SPEND = "day date, cost_micro bigint, calls bigint"
FIRES = "subscriber bigint, tick bigint, trigger string, id bigint"
LEVELS = "subscriber bigint, value double, direction string, note string, origin string"
MUTES = "subscriber bigint, from_ts timestamp, until_ts timestamp"
