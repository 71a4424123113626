"""Folds over ordered rows of one key, as a stream: a state is carried from row to row, and nothing else is held.

Where each step depends on what came of those before (a row of words hangs on its first
one, a chunk's size starts over), window functions can't express it. Rows are dealt by
their key and sorted inside each partition; a task then walks through them batch by batch,
however many rows a key has. Time is linear, and memory is one batch and one state.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_rows(rows: DataFrame, key: str, order: list[str], added: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]]) -> DataFrame:
    """``rows`` with columns ``added`` (a schema as text), which ``step(state, row)`` gives for each row of a key in ``order``.

    ``step`` returns the next state and the new columns' values; every key begins with
    ``start()``. A null key is a key of its own. Rows equal in ``order`` come in any order.
    """
    extra = StructType.fromDDL(added)
    kinds = to_arrow_schema(extra).types
    schema = StructType(rows.schema.fields + extra.fields)
    at = rows.columns.index(key)

    def run(batches):
        held, state = object(), None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            made = []
            for values in zip(*columns):
                if values[at] != held:
                    held, state = values[at], start()
                state, more = step(state, dict(zip(batch.schema.names, values)))
                made.append(more)
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c, kind in zip(zip(*made), kinds))], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
