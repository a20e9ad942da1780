"""Map Arrow batches: append columns that are computed from one text column, whatever else a row holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandworks.llm.common import free_name, staying

#: A batch of texts is cut into pieces of about so many bytes, so that a kernel's arrays stay small.
PIECE_BYTES = 8 << 20


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about PIECE_BYTES in the given column; a longer text is a piece of its own."""
    start = used = 0
    for i, n in enumerate(map(len_or_0, batch.column(column))):
        if used and used + n > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n
    if batch.num_rows > start:
        yield batch.slice(start)


def len_or_0(scalar: pa.Scalar) -> int:
    buffer = scalar.as_buffer()
    return 0 if buffer is None else buffer.size


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], kernel: Callable[[list], dict]) -> DataFrame:
    """``kernel(texts)`` (UTF-8 bytes or None) gives a list or array per field; fields replace columns of their names."""
    keep = staying(df, [f.name for f in fields])
    # the text comes first as bytes, under a name of its own
    inner = df.select(df[text].cast("binary").alias(free_name(df, "__bytes")), *[df[c] for c in keep])
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], *fields])
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                made = kernel(piece.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[1:], *[pa.array(made[f.name], type=t) for f, t in zip(fields, types, strict=True)]],
                    names=[*keep, *[f.name for f in fields]],
                )

    return inner.mapInArrow(run, schema)
