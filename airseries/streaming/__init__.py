"""Structured Streaming entry points (hourly readings landing)."""

from airseries.streaming.readings import (compact_readings, hourly_readings, land_events, merge_readings,
                                          score)

__all__ = ["compact_readings", "hourly_readings", "land_events", "merge_readings", "score"]
