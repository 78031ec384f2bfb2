"""Sequential folds: one small step function for batch and for streams.

`fold` streams each key's rows in order through a step with carried state. Rows
arrive in Arrow batches from a sorted partition, so memory holds one batch and one
state, whatever the group's size; callers pass keys that already split an entity at
points where the state provably resets.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_state: Callable,
         step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """`step(state, row) -> iterable of tuples`; `finish(state)` flushes a key."""
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [f.strip().split()[0] for f in schema.split(",")]
    idx = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = tuple(row[i] for i in idx)
                if k != key:
                    if state is not None and finish:
                        out.extend(finish(state))
                    key, state = k, new_state()
                out.extend(step(state, row))
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None and finish:
            out = list(finish(state))
            if out:
                yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, schema)
