"""Arrow batches in and out of tasks, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE_BYTES = 8 << 20
PIECE_ROWS = 2048


def pieces(batch: pa.RecordBatch, text: str, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch so that the texts of a piece hold at most ``size`` bytes; a longer text is a piece of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def mapped(
    df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], dict[str, list]],
    keep: list[str] | None = None, extra: list[str] | None = None, rows: int = PIECE_ROWS, size: int = PIECE_BYTES,
) -> DataFrame:
    """Add columns computed from bounded pieces of rows; ``fn`` returns one list per new field.

    ``keep`` names the input columns that stay (all by default), ``extra`` those that only ``fn``
    reads. A new column replaces a kept one of the same name.
    """
    names = {f.name for f in fields}
    kept = [c for c in dict.fromkeys(df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    added = [(f.name, arrow_type(f.dataType)) for f in fields]

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, text, rows, size):
                new = fn(piece)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in kept] + [pa.array(new[n], t) for n, t in added], kept + [n for n, _ in added]
                )

    needed = list(dict.fromkeys([*kept, text, *(extra or [])]))
    return df.select(*[df[f"`{c}`"] for c in needed]).mapInArrow(task, schema)
