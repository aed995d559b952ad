"""Column mapping from a physical table to the canonical readings columns.

Canonical columns: ``id, device_id, ts, reading_type, value, unit, metadata``. ``id`` is a
long, or a struct when several columns are needed to identify a row; either way it orders
rows that share a timestamp.
"""

from __future__ import annotations

from dataclasses import dataclass

READING_COLUMNS = ["id", "device_id", "ts", "reading_type", "value", "unit", "metadata"]


@dataclass(frozen=True)
class ReadingsSpec:
    """SQL expressions over the physical columns; optional parts may be left out."""

    id: tuple[str, ...]
    entity: str
    ts: str
    value: str | None = None
    type: str | None = None
    unit: str | None = None
    metadata: str | None = None
    precision: int = 10
    scale: int = 2


EVENT_READINGS = ReadingsSpec(
    id=("event_id + 1",),
    entity="concat('sensor-', lpad(cast(user_id as string), 6, '0'))",
    ts="ts",
    type="event_type",
    value="value",
    unit="concat('per_', event_type)",
    metadata="props",
)

ORDER_READINGS = ReadingsSpec(
    id=("o_orderkey + 1",),
    entity="concat('customer-', lpad(cast(o_custkey as string), 9, '0'))",
    ts="o_orderdate",
    type="o_orderstatus",
    value="o_totalprice",
    unit="'USD'",
    precision=15,
)

LINEITEM_READINGS = ReadingsSpec(
    id=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"),
    entity="concat('supplier-', lpad(cast(l_suppkey as string), 9, '0'))",
    ts="l_shipdate",
    type="l_returnflag",
    value="l_extendedprice",
    unit="'USD'",
    precision=15,
)

# The reading types and limits of the stored table.
READING_TYPES = ("temperature", "humidity", "pressure")
MAX_ENTITY_LENGTH = 50
MAX_TYPE_LENGTH = 20
MAX_UNIT_LENGTH = 20
