"""Adding columns to a table from its text column, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import give_back


def tidy(run: Callable) -> Callable:
    """A grouped function that gives memory back after each group."""

    def then(*args):
        out = run(*args)
        give_back()
        return out

    # the number of arguments tells whether there is a second table
    return (lambda key, table: then(key, table)) if run.__code__.co_argcount == 2 else (lambda key, table, side: then(key, table, side))


def with_text_features(
    df: DataFrame, features: Callable[[pa.Array], dict[str, pa.Array]], fields: list[T.StructField], text: str = "text"
) -> DataFrame:
    """``df`` with the columns of ``fields``, computed by ``features`` from the
    text column.  A column of the same name is replaced.  The texts of a batch
    are passed in runs of about 8 MB."""
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    if text not in kept:
        kept.append(text)
    out_cols = [c for c in kept if c in df.columns and c not in names]
    schema = T.StructType([*(df.schema[c] for c in out_cols), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * (8 << 20) / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                got = features(part.column(text))
                cols = [part.column(c) for c in out_cols] + [got[n] for n in names]
                yield pa.RecordBatch.from_arrays(cols, names=[*out_cols, *names])
        give_back()

    return df.select(*kept).mapInArrow(run, schema)
