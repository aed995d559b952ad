"""Time-series readings keyed by an entity, answered set-at-a-time on Spark."""

from tidemark.spec import EVENT_READINGS, LINEITEM_READINGS, ORDER_READINGS, ReadingsSpec

__all__ = ["ReadingsSpec", "EVENT_READINGS", "ORDER_READINGS", "LINEITEM_READINGS"]
