"""Traffic slices: operator A and operator B out of the rows per operator."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operator ids and the slice they belong to; other ids belong to none.
SLICES = {"CN Operator ID=0": "A", "CN Operator ID=1": "A", "CN Operator ID=2": "B"}


def slice_of(operator: Column, slices: Mapping[str, str] = SLICES) -> Column:
    result = F.lit(None).cast("string")
    for name in sorted(set(slices.values())):
        ids = [op for op, s in slices.items() if s == name]
        result = F.when(operator.isin(*ids), F.lit(name)).otherwise(result)
    return result


def with_slice(rows: DataFrame, slices: Mapping[str, str] = SLICES) -> DataFrame:
    """Rows of a known slice, with the column ``slice`` in place of ``cn_operator``."""
    named = rows.withColumn("slice", slice_of(F.col("cn_operator"), slices)).drop("cn_operator")
    return named.filter(F.col("slice").isNotNull())


def only_slice(rows: DataFrame, name: str, slices: Mapping[str, str] = SLICES) -> DataFrame:
    """Rows of one slice. The filter is on the stored column, so it reaches the scan."""
    if "slice" in rows.columns:
        return rows.filter(F.col("slice") == name)
    ids = [op for op, s in slices.items() if s == name]
    return rows.filter(F.col("cn_operator").isin(*ids))
