"""Model calls as injected functions: everything before and after a call is Spark, the call is the caller's.

The function gets a pandas frame of the named columns and returns one row per row, so that it may batch. Cheap
filters run first and are written out, since Catalyst has no cost for Python; the number of parallel calls is the
number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import materialise


def call(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], result: str, parallel: int = 8) -> DataFrame:
    """rows with the function's columns (DDL ``result``) and ``error``: a failing batch is tried row by row."""
    names = [x.split()[0] for x in result.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                out = function(b[columns]).reset_index(drop=True)
                yield pd.concat([b.reset_index(drop=True), out[names], pd.Series([None] * len(b), name="error", dtype=object)], axis=1)
            except Exception:
                for _, r in b.iterrows():
                    one = r.to_frame().T.reset_index(drop=True)
                    try:
                        out, error = function(one[columns]).reset_index(drop=True)[names], None
                    except Exception as e:
                        out, error = pd.DataFrame([[None] * len(names)], columns=names), f"{type(e).__name__}: {e}"[:200]
                    yield pd.concat([one, out, pd.Series([error], name="error", dtype=object)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), result, "error string"])
    return rows.repartition(parallel).mapInPandas(run, schema)


def filtered_call(rows: DataFrame, keep, order: list[str], most: int, function, columns: list[str], result: str, parallel: int = 8) -> DataFrame:
    """Cheap filter first, then at most ``most`` rows (a budget for calls, in a fixed order), then the function."""
    chosen = materialise(rows.filter(keep).orderBy(*order).limit(most), "chosen")
    return call(chosen, function, columns, result, parallel)


def fitness(correctness, procedure, conciseness, size=None, most: int | None = None):
    """Half correctness, three tenths procedure, two tenths conciseness, less a penalty near the size limit."""
    raw = 0.5 * correctness + 0.3 * procedure + 0.2 * conciseness
    if size is not None and most:
        ratio = size / most
        raw = raw - F.when(ratio > 0.9, F.least(F.lit(0.3), (ratio - 0.9) * 3.0)).otherwise(0.0)
    return F.greatest(F.lit(0.0), raw)
