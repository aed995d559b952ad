"""The whole path of a request table: validate, look up, decide outcomes, write documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.requests import (
    batch_latest,
    lookup_ids,
    request_outcome,
    to_documents,
    to_record_documents,
    validate_requests,
    with_text,
)
from tidemark.session import written


def answer_requests(req: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome per request, document per successful request)."""
    parsed = validate_requests(req)
    found = lookup_ids(parsed, readings)
    # Read for the outcomes and for the documents.
    hits = written(batch_latest(parsed, with_text(readings), carried=["text"]), "hits")
    by_device = request_outcome(parsed, hits).select("request_id", "outcome")
    outcomes = by_device.unionByName(found.select("request_id", "outcome"))
    documents = to_documents(parsed, hits).unionByName(to_record_documents(found))
    return outcomes, documents


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line; the text is already JSON."""
    documents.select("document").write.mode("overwrite").text(path)
