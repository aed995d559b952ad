"""All registered queries: name -> (query, SQL check or None)."""

from tidemark.catalog import readings, request_tables, stores, streams, telemetry, upkeep

CATALOG: dict = {}
for _area in (readings, request_tables, upkeep, stores, telemetry, streams):
    for _name, _entry in _area.CATALOG.items():
        if _name in CATALOG:
            raise ValueError(f"query {_name} registered twice")
        CATALOG[_name] = _entry
