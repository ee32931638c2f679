"""Comparison of results with golden ones, within a tolerance for each column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differences(golden: DataFrame, found: DataFrame, keys: Sequence[str], scales: dict[str, int] | None = None) -> DataFrame:
    """(keys..., column, golden, found) of values that differ, and a row with column `(row)` for keys that only one side has.

    Columns in scales may differ by half a unit of their last digit; all others must be equal, nulls to nulls. Keys are
    unique and may be null; rows that repeat a key are paired in the order of their values.
    """
    values = [c for c in golden.columns if c not in keys]
    numbered = lambda df: df.select(*keys, *values, F.row_number().over(Window.partitionBy(*keys).orderBy(*values, F.lit(0))).alias("__nth"))
    g, f = numbered(golden).withColumn("__in", F.lit(True)).alias("g"), numbered(found).withColumn("__in", F.lit(True)).alias("f")
    on = F.lit(True)
    for k in [*keys, "__nth"]:
        on = on & F.col(f"g.`{k}`").eqNullSafe(F.col(f"f.`{k}`"))
    both = g.join(f, on, "full")
    there = F.col("g.__in").isNotNull() & F.col("f.__in").isNotNull()
    parts = [F.when(~there, F.struct(F.lit("(row)").alias("column"), F.when(F.col("g.__in").isNotNull(), "present").alias("golden"), F.when(F.col("f.__in").isNotNull(), "present").alias("found")))]
    for c in values:
        a, b = F.col(f"g.`{c}`"), F.col(f"f.`{c}`")
        same = a.eqNullSafe(b)
        if c in (scales or {}):
            same = same | F.coalesce(F.abs(a - b) <= 0.5 * 10.0 ** -scales[c] + 1e-12, F.lit(False))
        parts.append(F.when(there & ~same, F.struct(F.lit(c).alias("column"), a.cast("string").alias("golden"), b.cast("string").alias("found"))))
    keyed = [F.coalesce(F.col(f"g.`{k}`"), F.col(f"f.`{k}`")).alias(k) for k in keys]
    return both.select(*keyed, F.explode(F.array_compact(F.array(*parts))).alias("d")).select(*keys, "d.column", "d.golden", "d.found")

