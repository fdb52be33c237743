"""Arrow-batched functions that are made when first used, so modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows that a function sees at once; what it makes on its way grows with them, not with the batch.
ROWS = 256


def sliced(f: Callable[..., pd.Series]) -> Callable[..., pd.Series]:
    """``f`` over slices of ``ROWS`` rows of its columns, whose results are put together."""

    def run(*cols: pd.Series) -> pd.Series:
        n = len(cols[0])
        return f(*cols) if n <= ROWS else pd.concat([f(*(c.iloc[i : i + ROWS] for c in cols)) for i in range(0, n, ROWS)])

    return run


def batched(kind: str) -> Callable[[Callable[..., pd.Series]], Callable[..., Column]]:
    """A pandas UDF of the DDL type ``kind``, called with columns or their names."""

    def wrap(f: Callable[..., pd.Series]) -> Callable[..., Column]:
        bounded = sliced(f)

        def call(*cols: Column | str) -> Column:
            if not kind.startswith("struct<"):
                return F.pandas_udf(bounded, kind, F.PandasUDFType.SCALAR)(*cols)
            # A pandas UDF of a struct must return a frame; a list of one struct keeps nested nulls as they are.
            return F.get(F.pandas_udf(lambda *x: bounded(*x).map(lambda v: [v]), f"array<{kind}>", F.PandasUDFType.SCALAR)(*cols), 0)

        call.__doc__ = f.__doc__
        return call

    return wrap
