"""User models over batches of rows; the models themselves stay outside this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame


def apply_model(rows: DataFrame, make_model: Callable[[], Callable], arguments: Mapping[str, str], outputs: str) -> DataFrame:
    """Append a model's output columns. `make_model()` runs once per Python worker and partition.

    The model takes the named pandas columns and returns one series per output column.
    """
    names = [part.split()[0] for part in outputs.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            found = model(**{name: batch[column] for name, column in arguments.items()})
            yield batch.assign(**dict(zip(names, found)))

    return rows.mapInPandas(run, schema)
