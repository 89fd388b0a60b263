"""Running sums, lags and ranks within groups of any size, without a window over a whole group.

A group is cut into chunks of its order. What a chunk's rows need from earlier chunks (sums, the last value) is found
over one row per chunk, and only the rows of one chunk are windowed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunk of the rows without a place in the order; they come first.
NO_CHUNK = -(1 << 62)


def running_sums(rows: DataFrame, by: list[str], chunk: Column, order: list, sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """Adds, per name of ``sums``, the sum of the column over the group's rows up to and with this one, and per name
    of ``lags`` the column's value in the row before (null for the group's first).

    order: columns (ascending, nulls first). chunk must not decrease along it; rows of a chunk meet in one task.
    """
    sums, lags = sums or {}, lags or {}
    cut = rows.withColumn("__chunk", F.coalesce(chunk, F.lit(NO_CHUNK)))
    last = {n: F.max_by(F.struct(c.alias("x")), F.struct(*order)) for n, c in lags.items()}
    totals = cut.groupBy(*by, "__chunk").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()), *(c.alias(f"__{n}") for n, c in last.items()))
    chunks = Window.partitionBy(*by).orderBy("__chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums] + [F.lag(f"__{n}").over(chunks).alias(f"__{n}") for n in lags]
    totals = totals.select(*by, "__chunk", *carried)
    inner = Window.partitionBy(*by, "__chunk").orderBy(*order)
    new = {n: F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}
    new |= {n: F.lag(F.struct(c.alias("x"))).over(inner) for n, c in lags.items()}
    joined = cut.withColumns(new).join(totals, [*by, "__chunk"])
    done = {n: F.col(n) + F.col(f"__{n}") for n in sums} | {n: F.coalesce(n, f"__{n}")["x"] for n in lags}
    return joined.withColumns(done).drop("__chunk", *(f"__{n}" for n in (*sums, *lags)))


def equal_ranges(rows: DataFrame, column: str, k: int) -> Column:
    """The number of a numeric column's range among k equal ones between its ends (0 to k); -1 for null."""
    x = F.col(column).cast("double")
    ends = rows.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).alias("ends")).scalar()
    return F.when(x.isNull(), -1).otherwise(F.coalesce(F.floor((x - ends["lo"]) * k / F.nullif(ends["hi"] - ends["lo"], F.lit(0.0))), F.lit(0)))
