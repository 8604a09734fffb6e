"""Status, stage and risk vocabularies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in pipeline order.
STATUSES = ("UPLOADED", "QUEUED", "PROCESSING", "OCR_PROCESSING", "CHUNKING", "EMBEDDING", "INDEXING", "COMPLETED", "FAILED")
STATUS_LABELS = ("Uploaded", "Queued", "Parsing", "OCR", "Chunking", "Embedding", "Indexing", "Ready", "Failed")
STEPS = ("QUEUED", "PROCESSING", "OCR_PROCESSING", "CHUNKING", "EMBEDDING", "INDEXING", "COMPLETED")
STAGES = ("parse", "ocr", "chunk", "embed", "index")
STAGE_PROGRESS = (25, 45, 65, 85, 100)


def lookup(key: Column, keys, values) -> Column:
    pairs = [F.lit(x) for item in zip(keys, values, strict=True) for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def status_label(status: Column) -> Column:
    return lookup(status, STATUSES, STATUS_LABELS)


def next_status(status: Column) -> Column:
    """The state after this one; none after the last two."""
    return lookup(status, STATUSES[:7], STATUSES[1:8])


def step_index(status: Column, failed_at: Column) -> Column:
    """Position in the visible steps; a failure shows where it failed, else at parsing."""
    shown = F.when(status == "FAILED", F.coalesce(failed_at, F.lit("PROCESSING"))).when(status == "UPLOADED", "QUEUED").otherwise(status)
    return lookup(shown, STEPS, range(len(STEPS)))


def is_processing(status: Column) -> Column:
    return ~status.isin("COMPLETED", "FAILED")


def status_of_order(code: Column) -> Column:
    """Stand-in: an order's status letter as a document status."""
    return F.when(code == "F", "COMPLETED").when(code == "O", "PROCESSING").otherwise("FAILED")


def severity_of_order(priority: Column) -> Column:
    """Stand-in: an order's priority as a risk level."""
    first = F.substring(priority, 1, 1)
    return F.when(first == "1", "high").when(first.isin("2", "3"), "medium").otherwise("low")
