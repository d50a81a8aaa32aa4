"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from . import drawn_queries, episode_queries, frame_queries, more_queries, registry, sensor_queries, world_queries

__all__ = ["drawn_queries", "episode_queries", "frame_queries", "more_queries", "oracle_sql", "queries", "sensor_queries", "world_queries"]


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
