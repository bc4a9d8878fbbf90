"""Foreign keys that do not resolve.

A null key is missing, not wrong: such rows are kept (gold points them at the
unknown member) and the not-null checks count them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK = "ok"
QUARANTINE = "quarantine"


def split_fk(
    df: DataFrame, ref: DataFrame, fk: str, pk: str, ref_is_unique: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Splits rows into those whose foreign key resolves or is null, and the rest.

    A reference whose key repeats is reduced to distinct keys first, on both
    sides of the shuffle. A unique one is joined as it is, which lets adaptive
    execution split a hot foreign key over several tasks.
    """
    known = ref.select(F.col(pk).alias("_ref_key"))
    if not ref_is_unique:
        known = known.distinct()
    resolved = df.join(known, F.col(fk) == F.col("_ref_key"), "left")
    ok = resolved.filter(F.col("_ref_key").isNotNull() | F.col(fk).isNull()).drop("_ref_key")
    bad = df.filter(F.col(fk).isNotNull()).join(
        known, F.col(fk) == F.col("_ref_key"), "left_anti"
    )
    return ok, bad


def orphan_keys(df: DataFrame, ref: DataFrame, fk: str, pk: str) -> DataFrame:
    """The distinct foreign keys, in column ``fk``, that do not resolve.

    Only the key column is read and shuffled, and repeated keys are merged
    before the shuffle, so neither wide rows nor a hot key are moved.
    """
    present = df.select(fk).filter(F.col(fk).isNotNull()).distinct()
    known = ref.select(F.col(pk).alias(fk))
    return present.join(known, fk, "left_anti")


def mark_orphans(df: DataFrame, orphans: Mapping[str, DataFrame]) -> DataFrame:
    """Adds ``row_status`` and, for rows set aside, the keys that did not resolve.

    ``orphans`` holds the result of ``orphan_keys`` per foreign key. When those
    were written and read back, their size is known and usually tiny, so Spark
    broadcasts them and the rows of ``df`` are not shuffled for this at all.
    """
    marked = df
    reasons = []
    for fk, keys in orphans.items():
        flag = f"_orphan_{fk}"
        marked = marked.join(keys.withColumn(flag, F.lit(True)), fk, "left")
        reasons.append(F.when(F.col(flag), F.lit(fk)))
    reason = F.nullif(F.concat_ws(",", *reasons), F.lit("")) if reasons else F.lit(None)
    return marked.select(
        *df.columns,
        reason.cast("string").alias("reject_reason"),
    ).withColumn(
        "row_status", F.when(F.col("reject_reason").isNull(), OK).otherwise(QUARANTINE)
    )
