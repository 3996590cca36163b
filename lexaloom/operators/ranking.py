"""Numbering of rows without bringing all of them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: Sequence[Column], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row in ``order``.

    group: expressions of which the first rows of ``order`` are a refinement
    (rows of a smaller group come before all rows of a larger one). Sums per group, of which there are few, are
    accumulated first; then each group accumulates its own rows."""
    keys = [f"__g{i}" for i in range(len(group))]
    marked = df.withColumns(dict(zip(keys, group, strict=True))).withColumn("__value", value)
    sums = marked.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = marked.withColumn("__own", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys]
    return own.join(bases, on).withColumn(name, (F.col("__base") + F.col("__own")).cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, group: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """Adds the dense number of each row in ``order``, from 1; groups as in running_total."""
    return running_total(df, group, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)
