"""Running totals over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices that all rows together are cut into, and rows sampled to find where.
SLICES, SAMPLE = 128, 16_384
_HASHES = 1 << 31


def sort_key(order: Sequence[str]) -> Column:
    """What rows are sorted by, rising: columns by name, a number with "-" before it falling."""
    return F.struct(
        *(
            (-F.col(name[1:]) if name.startswith("-") else F.col(name)).alias(f"k{i}")
            for i, name in enumerate(order)
        )
    )


def splitters(df: DataFrame, group: str, order: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Where to cut each group: ``group`` and the sorted ``_splitters`` among its sort keys.

    They are evenly spaced among the sampled rows of the group, one per ``SAMPLE / slices`` of
    them, so there are about ``slices`` in all, however many groups or rows there are. A
    row is sampled by a hash of its key, so computing this again gives the same.
    """
    key = sort_key(order)
    count = df.select(F.count(F.lit(1))).scalar()
    chance = F.pmod(F.xxhash64(group, key), F.lit(_HASHES)).cast("double") / _HASHES
    sampled = df.where(chance * count < SAMPLE).groupBy(group)
    keys = sampled.agg(F.sort_array(F.collect_list(key)).alias("_keys"))
    apart = SAMPLE // slices
    cuts = F.filter("_keys", lambda _, i: (i + 1) % apart == 0)
    return keys.select(group, cuts.alias("_splitters")).where(F.size("_splitters") > 0)


def sorted_slices(
    df: DataFrame, group: str, order: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """Cuts rows into slices along group and order; ``_slice`` numbers them in each group.

    Rows of a lower slice come before all rows of a higher one. The slice of a row is the
    number of splitters of its group that come before it.
    """
    # About `slices` sort keys in all: see there.
    cuts = F.broadcast(splitters(df, group, order, slices))
    key = sort_key(order)
    below = F.size(F.filter("_splitters", lambda cut: cut < key))
    cut = df.join(cuts, group, "left")
    number = F.when(F.col("_splitters").isNull(), 0).otherwise(below)
    return cut.withColumn("_slice", number).drop("_splitters")


def running_total(
    df: DataFrame, group: str, order: Sequence[str], value: str, slices: int = SLICES
) -> DataFrame:
    """Adds ``group_total`` and ``running_total`` of ``value`` in ``order``.

    A window over the group alone would sort each group in one task. Here the
    rows are cut into slices along group and order, slices are summed, and each
    row gets the sum inside its slice plus that of the slices before it. The
    result is exact, whatever the slices are, and nothing runs while it is built.

    ``group`` must not be null and ``order`` must leave no ties.
    """
    sliced = sorted_slices(df, group, order, slices)
    slice_sums = sliced.groupBy(group, "_slice").agg(F.sum(value).alias("_slice_sum"))
    # One row per slice from here to the join.
    whole_group = Window.partitionBy(group)
    earlier = whole_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_sums.select(
        group,
        "_slice",
        F.coalesce(F.sum("_slice_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_slice_sum").over(whole_group).alias("group_total"),
    )
    inside = (
        Window.partitionBy(group, "_slice")
        .orderBy(sort_key(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.join(offsets, [group, "_slice"])
        .withColumn("running_total", F.sum(value).over(inside) + F.col("_before"))
        .drop("_slice", "_before")
    )
