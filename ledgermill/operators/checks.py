"""Data quality checks.

Every check returns rows of one shape: check_id, layer, table_name, severity,
total, failed, passed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ERROR = "error"
WARNING = "warning"

# Fingerprints that two tables are compared by.
RECON_BUCKETS = 1 << 16

RESULT_DDL = (
    "check_id string, layer string, table_name string, severity string, "
    "total bigint, failed bigint, passed boolean"
)


@dataclass(frozen=True)
class Rule:
    """A condition that is true for rows breaking a rule. Null counts as kept."""

    check_id: str
    severity: str
    broken: Column


def not_null(table: str, column: str, severity: str) -> Rule:
    return Rule(f"not_null:{table}.{column}", severity, F.col(column).isNull())


def accepted_values(table: str, column: str, values: Sequence[str], severity: str) -> Rule:
    return Rule(f"accepted_values:{table}.{column}", severity, ~F.col(column).isin(*values))


def in_range(
    table: str,
    column: str,
    low: Decimal | date | None,
    high: Decimal | date | None,
    severity: str,
) -> Rule:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < F.lit(low))
    if high is not None:
        outside = outside | (F.col(column) > F.lit(high))
    return Rule(f"range:{table}.{column}", severity, outside)


def rule_counts(rules: Sequence[Rule], among: Column | None = None) -> list[Column]:
    """Rows in all, and rows that break each rule, of those that ``among`` holds for."""
    counted = F.lit(True) if among is None else among
    return [
        F.count_if(counted).alias("total"),
        *(F.count_if(counted & rule.broken).alias(f"failed_{i}") for i, rule in enumerate(rules)),
    ]


def rule_results(
    counts: DataFrame, layer: str, table: str, rules: Sequence[Rule]
) -> DataFrame:
    """One result row per rule from the one row of ``rule_counts``."""
    results = F.array(
        *(
            F.struct(
                F.lit(rule.check_id).alias("check_id"),
                F.lit(rule.severity).alias("severity"),
                F.col(f"failed_{i}").alias("failed"),
            )
            for i, rule in enumerate(rules)
        )
    )
    checked = counts.select("total", F.inline(results))
    return _result(checked, F.col("check_id"), layer, table, F.col("severity"))


def row_rules(df: DataFrame, layer: str, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Checks all rules in one aggregate over one scan; one result row per rule."""
    return rule_results(df.agg(*rule_counts(rules)), layer, table, rules)


def unique(
    df: DataFrame, layer: str, table: str, keys: Sequence[str], severity: str
) -> DataFrame:
    """``failed`` counts the rows beyond the first per key; null keys are left out."""
    complete = reduce(lambda a, b: a & b, (F.col(key).isNotNull() for key in keys))
    per_key = df.filter(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("failed"))
    return _result(counts, F.lit(f"unique:{table}.{'+'.join(keys)}"), layer, table, severity)


def referential(
    df: DataFrame,
    ref: DataFrame,
    layer: str,
    table: str,
    ref_table: str,
    fk: str,
    pk: str,
    severity: str,
) -> DataFrame:
    """``total`` counts non-null foreign keys, ``failed`` those that do not resolve.

    Rows are counted per key before the join, so one key value held by very many
    rows is one row by then. ``pk`` must be unique in ``ref``.
    """
    per_key = (
        df.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    )
    known = ref.select(F.col(pk).alias("_ref_key"))
    joined = per_key.join(known, F.col(fk) == F.col("_ref_key"), "left")
    counts = joined.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("_ref_key").isNull(), F.col("n")).otherwise(0)).alias("failed"),
    )
    check_id = F.lit(f"referential:{table}.{fk}->{ref_table}.{pk}")
    return _result(counts, check_id, layer, table, severity)


def references(
    df: DataFrame, refs: Sequence[tuple[str, str, str, DataFrame]], layer: str, table: str, severity: str
) -> DataFrame:
    """``referential`` of several foreign keys (fk, referred table, pk, its rows) in one scan.

    Every row gives one entry per key column, and entries are counted per column and value
    before anything is shuffled. Keys are compared as bigint.
    """
    # Columns go by number, as numbers are hashed and moved at less cost than names.
    entry = [
        F.struct(F.lit(i).alias("fk"), F.col(fk).cast("bigint").alias("key"))
        for i, (fk, *_) in enumerate(refs)
    ]
    entries = df.select(F.inline(F.array(*entry))).filter("key is not null")
    per_key = entries.groupBy("fk", "key").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(
        DataFrame.unionByName,
        (
            ref.select(F.lit(i).alias("fk"), F.col(pk).cast("bigint").alias("key"))
            for i, (_, _, pk, ref) in enumerate(refs)
        ),
    )
    joined = per_key.join(known.withColumn("_known", F.lit(True)), ["fk", "key"], "left")
    counts = joined.groupBy("fk").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).alias("failed"),
    )
    # A column without a single key is checked as well, with nothing to fail.
    names = [
        F.struct(F.lit(i).alias("fk"), F.lit(f"referential:{table}.{fk}->{to}.{pk}").alias("check"))
        for i, (fk, to, pk, _) in enumerate(refs)
    ]
    every = df.sparkSession.range(1).select(F.inline(F.array(*names)))
    return _result(every.join(counts, "fk", "left"), F.col("check"), layer, table, severity)


def layer_counts(
    expected: DataFrame, actual: DataFrame, layer: str, severity: str = ERROR
) -> DataFrame:
    """Compares two manifests; ``failed`` is by how many rows a table differs."""
    joined = expected.select("table_name", F.col("n_rows").alias("want")).join(
        actual.select("table_name", F.col("n_rows").alias("have")), "table_name", "full"
    )
    want, have = F.coalesce("want", F.lit(0)), F.coalesce("have", F.lit(0))
    counts = joined.select(
        "table_name", want.alias("total"), F.abs(have - want).alias("failed")
    )
    check_id = F.concat(F.lit("layer_counts:"), F.col("table_name"))
    return _result(counts, check_id, layer, F.col("table_name"), severity)


def row_recon(
    left: DataFrame,
    right: DataFrame,
    layer: str,
    table: str,
    check_id: str,
    severity: str = ERROR,
    key: str | None = None,
) -> DataFrame:
    """Counts rows held by one side and not by the other, copies included.

    The same answer as ``exceptAll`` both ways. Rows are put in buckets by a hash of
    ``key`` (the first column by default), and each bucket gets a fingerprint: its number of rows and the sums of two
    hashes of all columns, those of the left minus those of the right, added up before
    anything is shuffled. Only rows of buckets whose fingerprint is not zero are shuffled and
    compared, which are none where both sides agree.
    """
    key = key or left.columns[0]
    right = right.select(*left.columns)
    prints = _fingerprints(left, key, 1).unionByName(_fingerprints(right, key, -1))
    names = [name for name in prints.columns if name != "_bucket"]
    per_bucket = prints.groupBy("_bucket").agg(*(F.sum(name).alias(name) for name in names))
    differ = reduce(lambda a, b: a | b, (F.col(name) != 0 for name in names))
    # At most one number for each of RECON_BUCKETS.
    open_buckets = F.broadcast(per_bucket.filter(differ).select("_bucket"))

    sides = (
        side.withColumns({"_bucket": _bucket(key), "_side": F.lit(sign)}).join(
            open_buckets, "_bucket", "left_semi"
        )
        for side, sign in ((left, 1), (right, -1))
    )
    per_row = reduce(DataFrame.unionByName, sides).groupBy(*left.columns)
    surplus = per_row.agg(F.sum("_side").alias("surplus"))
    none = F.lit(0).cast("bigint")
    total = left.agg(F.count(F.lit(1)).alias("total")).select("total", none.alias("failed"))
    counts = total.unionByName(
        surplus.select(none.alias("total"), F.abs("surplus").alias("failed"))
    )
    counts = counts.agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"))
    return _result(counts, F.lit(check_id), layer, table, severity)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RECON_BUCKETS)).cast("int")


def _fingerprints(side: DataFrame, key: str, sign: int) -> DataFrame:
    """Rows, and signed sums of two row hashes, per bucket.

    Sums are of halves of 32 bits, so 2^31 rows of a bucket fit. A hash passes over nulls, so
    which columns are null is hashed too.
    """
    # A bit for each column, in numbers of 32.
    bits = [F.col(name).isNull().cast("bigint") for name in side.columns]
    nulls = [
        reduce(lambda a, b: a + b, (F.shiftleft(bit, i) for i, bit in enumerate(bits[k : k + 32])))
        for k in range(0, len(bits), 32)
    ]
    hashes = [F.xxhash64(F.lit(seed), *nulls, *side.columns) for seed in (1, 2)]
    halves = [
        half
        for value in hashes
        for half in (F.shiftrightunsigned(value, 32), value.bitwiseAND(0xFFFFFFFF))
    ]
    return side.groupBy(_bucket(key).alias("_bucket")).agg(
        (F.count(F.lit(1)) * sign).alias("rows"),
        *((F.sum(half) * sign).alias(f"print_{i}") for i, half in enumerate(halves)),
    )


def amount_recon(
    headers: DataFrame,
    lines: DataFrame,
    layer: str,
    table: str,
    header_key: str,
    header_total: str,
    line_key: str,
    line_total: str,
    tolerance: Decimal,
    severity: str = WARNING,
) -> DataFrame:
    """Counts headers whose total is off the sum of their lines by the tolerance or more.

    Lines are summed before the join; headers without a line are left out.
    """
    summed = lines.groupBy(line_key).agg(F.sum(line_total).alias("_line_sum"))
    joined = headers.select(header_key, header_total).join(
        summed, F.col(header_key) == F.col(line_key)
    )
    off_by = F.abs(F.col(header_total) - F.col("_line_sum"))
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(off_by >= F.lit(tolerance)).alias("failed"),
    )
    return _result(
        counts, F.lit(f"amount_recon:{table}.{header_total}"), layer, table, severity
    )


def date_coverage(
    dim_date: DataFrame,
    facts: DataFrame,
    layer: str,
    table: str,
    date_key: str,
    severity: str = WARNING,
) -> DataFrame:
    """Counts calendar days between the first and last fact that hold no fact."""
    used = facts.filter(F.col(date_key) > 0).select(F.col(date_key).alias("date_key")).distinct()
    first, last = (used.select(edge("date_key")).scalar() for edge in (F.min, F.max))
    days = dim_date.select("date_key").filter(F.col("date_key").between(first, last))
    counts = days.join(used.withColumn("_used", F.lit(True)), "date_key", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_used").isNull()).alias("failed")
    )
    return _result(counts, F.lit(f"date_coverage:{table}.{date_key}"), layer, table, severity)


def set_aside_counts() -> list[Column]:
    """Source rows of a cleaned table, and those of them in quarantine."""
    aside = F.when(F.col("row_status") == "quarantine", F.col("source_rows"))
    return [F.sum("source_rows").alias("total"), F.sum(aside).alias("failed")]


def set_aside_result(counts: DataFrame, table: str, allowed: float) -> DataFrame:
    """An error where more than the share ``allowed`` is set aside."""
    too_many = F.coalesce("failed", F.lit(0)) > allowed * F.coalesce("total", F.lit(0))
    severity = F.when(too_many, F.lit(ERROR)).otherwise(F.lit(WARNING))
    return _result(counts, F.lit(f"quarantine:{table}"), "silver", table, severity)


def set_aside(df: DataFrame, table: str, allowed: float) -> DataFrame:
    """Source rows of a cleaned table in quarantine: an error above the share ``allowed``."""
    return set_aside_result(df.agg(*set_aside_counts()), table, allowed)


def schema_problems(df: DataFrame, contract: StructType) -> list[str]:
    """How names, order or types of the columns differ from the contract."""
    problems = []
    have = [(field.name, field.dataType.simpleString()) for field in df.schema]
    want = [(field.name, field.dataType.simpleString()) for field in contract]
    if [name for name, _ in have] != [name for name, _ in want]:
        problems.append(
            f"columns are {[name for name, _ in have]}, not {[name for name, _ in want]}"
        )
    types = dict(have)
    for name, kind in want:
        if name in types and types[name] != kind:
            problems.append(f"{name} is {types[name]}, not {kind}")
    return problems


class DataQualityError(Exception):
    """A check of severity ``error`` failed."""


def gate(summary: DataFrame) -> None:
    """Raises when a check of severity ``error`` failed.

    Collects the failing rows of the summary, of which there is one per check.
    """
    broken = summary.filter((F.col("severity") == ERROR) & ~F.col("passed")).collect()
    if broken:
        listed = ", ".join(f"{row.check_id} ({row.failed} of {row.total})" for row in broken)
        raise DataQualityError(f"failed checks: {listed}")


def _result(
    counts: DataFrame, check_id: Column, layer: str, table: Column | str, severity: Column | str
) -> DataFrame:
    """Brings counts to the common shape; sums over no rows become 0."""
    total = F.coalesce(F.col("total"), F.lit(0)).cast("bigint")
    failed = F.coalesce(F.col("failed"), F.lit(0)).cast("bigint")
    return counts.select(
        check_id.alias("check_id"),
        F.lit(layer).alias("layer"),
        (F.lit(table) if isinstance(table, str) else table).alias("table_name"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        total.alias("total"),
        failed.alias("failed"),
        (failed == 0).alias("passed"),
    )
