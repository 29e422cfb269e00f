"""Terrain, climate, road-network, message-log and run analytics as Spark jobs."""

from rillwork.session import cut, get_session

__all__ = ["cut", "get_session"]
