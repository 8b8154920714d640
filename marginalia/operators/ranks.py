"""Order statistics without a task per group: running counts over ranges of values (AGG-12, AGG-14, AGG-16, WIN-2, WIN-3).

Equal values are counted first.  A group's values are then cut into parts by a monotone function of the value itself,
so no sampling and no second look at the rows is needed: windows run within a part, and a small table of the parts'
counts says how much lies before each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import join_same

STEPS = 4096  # parts between two powers of two
_SPAN = 2000 * STEPS  # more than any exponent of a double takes


def value_part(value: Column) -> Column:
    """A number that never falls as the value rises: exponent and leading digits of its binary form, by sign."""
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    place = exponent * STEPS + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS) + _SPAN
    inner = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2 * _SPAN)).otherwise(place)
    return F.when(value < 0, -inner).otherwise(inner).cast("long")


def running(counts: DataFrame, group: Sequence[str], value: str, *ns: str) -> DataFrame:
    """``counts``, one row per group and value, with ``_before``, how many are smaller, and ``_total`` of the group.

    With several columns of counts, each has its own ``<column>_before``; without any, ``_n`` is the one.
    """
    before = {n: f"{n}_before" for n in ns} or {"_n": "_before"}
    total = {n: f"{n}_total" for n in ns} or {"_n": "_total"}
    placed = counts.withColumn("_part", value_part(F.col(value)))
    sums = placed.groupBy(*group, "_part").agg(*(F.sum(n).alias(n) for n in before))
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_part", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_skip{n}") for n in before), *(F.sum(n).over(whole).alias(total[n]) for n in before))
    within = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *(F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"_own{n}") for n in before))
    both = join_same(local, offsets, [*group, "_part"])
    return both.select(*counts.columns, *((F.col(f"_skip{n}") + F.col(f"_own{n}")).alias(before[n]) for n in before), *total.values())


def counted(rows: DataFrame, group: Sequence[str], value: str, n: str | None = None) -> DataFrame:
    """(group, value, _n): how often each value occurs; ``n`` names a column that counts rows already."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(n) if n else F.count("*")).alias("_n"))


def at_rank(value: str, rank: Column) -> Column:
    """In an aggregation over ``running``: the value with this rank, from 1."""
    return F.min(F.when(F.col("_before") + F.col("_n") >= rank, F.col(value)))


def medians(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """(group, name): the mean of the two middle values, nulls aside; groups without any have no row."""
    total = F.col("_total")
    low, high = at_rank(value, F.floor((total + 1) / 2)), at_rank(value, F.floor(total / 2) + 1)
    return running(counted(rows, group, value), group, value).groupBy(*group).agg(((low + high) / 2).alias(name))


def average_ranks(counts: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """WIN-3 (group, value, name): the mean rank of each value."""
    return running(counts, group, value).select(*group, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
