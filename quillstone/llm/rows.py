"""Row functions run over Arrow batches, with results yielded in small batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

#: Input rows that are Python objects at once.
BATCH = 256


def values(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, which may hold many long texts; ``BATCH`` of them at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns), strict=True)


def map_rows(df: DataFrame, columns: list[str], row: Callable[..., Iterable[tuple]], out: pa.Schema, batch_rows: int = 1024) -> DataFrame:
    """``row(*values)`` gives the result rows of one input row, over ``columns`` of ``df``.

    Only the named columns are read, so no other column can clash with the results.
    Result batches hold ``batch_rows`` rows at most, so a task's memory does not
    grow with its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for given in values(batches):
            rows.extend(row(*given))
            if len(rows) >= batch_rows:
                yield as_batch(rows, out)
                rows = []
        if rows:
            yield as_batch(rows, out)

    return df.select(*columns).mapInArrow(run, from_arrow_schema(out))


def as_batch(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        while f"__{stem}" in taken:
            stem += "_"
        found.append(f"__{stem}")
    return found
