from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from ledgermill.operators.dedup import dedup_latest, exact_dedup
from ledgermill.operators.foreign_keys import mark_orphans, orphan_keys, split_fk
from ledgermill.operators.running import running_total, sorted_slices, splitters
from ledgermill.operators.union import union_all


def test_exact_dedup_counts_copies(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")]
    df = spark.createDataFrame(rows, "k int, t string")
    assertDataFrameEqual(exact_dedup(df), spark.createDataFrame(list(set(rows)), df.schema))
    counted = exact_dedup(df, copies="n").collect()
    assert {(row.k, row.t): row.n for row in counted} == Counter(rows)


def test_dedup_latest_takes_first_in_order(spark):
    df = spark.createDataFrame(
        [(1, 5, "old"), (1, 9, "b"), (1, 9, "a"), (2, None, "x"), (None, 1, "y")],
        "k int, at int, t string",
    )
    kept = dedup_latest(df, ["k"], [F.desc("at"), F.asc("t")]).collect()
    assert {tuple(row) for row in kept} == {(1, 9, "a"), (2, None, "x"), (None, 1, "y")}


@pytest.fixture
def children(spark):
    return spark.createDataFrame(
        [(1, 10), (2, 10), (3, 99), (4, None), (5, 20)], "id int, parent int"
    )


@pytest.fixture
def parents(spark):
    return spark.createDataFrame([(10,), (20,), (30,)], "pk int")


def ids(df):
    return sorted(row.id for row in df.collect())


def test_split_fk_keeps_null_keys(children, parents):
    ok, bad = split_fk(children, parents, "parent", "pk")
    assert ids(ok) == [1, 2, 4, 5]
    assert ids(bad) == [3]
    assert ok.columns == bad.columns == children.columns


def test_split_fk_with_repeated_reference_keys(children, parents):
    ok, bad = split_fk(
        children, union_all(parents, parents, parents), "parent", "pk", ref_is_unique=False
    )
    assert ids(ok) == [1, 2, 4, 5]
    assert ids(bad) == [3]


def test_split_fk_with_null_in_reference(spark, children):
    ok, bad = split_fk(children, spark.createDataFrame([(None,)], "pk int"), "parent", "pk")
    assert ids(ok) == [4]
    assert ids(bad) == [1, 2, 3, 5]


def test_orphans_give_the_same_split(children, parents):
    orphans = orphan_keys(children, parents, "parent", "pk")
    assert [row.parent for row in orphans.collect()] == [99]
    marked = mark_orphans(children, {"parent": orphans})
    ok, bad = split_fk(children, parents, "parent", "pk")
    assert ids(marked.filter("row_status = 'ok'")) == ids(ok)
    assert ids(marked.filter("row_status = 'quarantine'")) == ids(bad)


def test_reject_reason_names_every_orphan_key(spark):
    df = spark.createDataFrame([(1, 7, 8), (2, 7, 1), (3, 1, 1)], "id int, a int, b int")
    orphans = {
        "a": spark.createDataFrame([(7,)], "a int"),
        "b": spark.createDataFrame([(8,)], "b int"),
    }
    reasons = {row.id: row.reject_reason for row in mark_orphans(df, orphans).collect()}
    assert reasons == {1: "a,b", 2: "a", 3: None}


def test_mark_without_references(children):
    marked = mark_orphans(children, {})
    assert marked.filter("row_status = 'ok' and reject_reason is null").count() == 5


def test_slices_of_a_group_follow_its_order(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, "big").otherwise("small").alias("g"),
        (F.col("id") % 3).alias("v"),
        F.col("id").alias("k"),
    )
    sliced = sorted_slices(df, "g", ["-v", "k"])
    rows = sorted(sliced.collect(), key=lambda row: (row.g, -row.v, row.k))
    slices = [row._slice for row in rows]
    of_big = [row._slice for row in rows if row.g == "big"]
    assert of_big == sorted(of_big)
    assert len(set(of_big)) >= 5
    assert max(Counter(of_big).values()) <= 128
    assert len(slices) == 1000


def test_splitters_are_few_and_the_same_each_time(spark):
    df = spark.range(200_000).select((F.col("id") % 400).alias("g"), F.col("id").alias("k"))
    one_group = df.withColumn("g", F.lit(1))
    for frame in (df, one_group):
        cuts = splitters(frame, "g", ["-k"])
        first, again = (sorted(cuts.collect()) for _ in range(2))
        assert first == again
        assert sum(len(row._splitters) for row in first) <= 1.2 * 128
    (row,) = splitters(one_group, "g", ["-k"]).collect()
    keys = [-cut.k0 for cut in row._splitters]
    assert all(500 < a - b < 3000 for a, b in zip(keys, keys[1:], strict=False))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_total_equals_brute_force(spark, monkeypatch, seed):
    """One group has most rows, and a third of all rows share one value."""
    monkeypatch.setattr("ledgermill.operators.running.SAMPLE", 200 * seed)
    rng = random.Random(seed)
    rows = []
    for key in range(600):
        group = "big" if rng.random() < 0.8 else rng.choice(["b", "c"])
        value = Decimal(0) if rng.random() < 0.33 else Decimal(rng.randrange(10_000)) / 100
        rows.append((group, key, value))
    df = spark.createDataFrame(rows, "g string, k bigint, v decimal(18,2)").repartition(5)
    result = running_total(df, "g", ["-v", "k"], "v", slices=20).collect()

    want = {}
    totals = defaultdict(Decimal)
    for group, key, value in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        totals[group] += value
        want[key] = totals[group]
    assert {row.k: row.running_total for row in result} == want
    assert {row.g: row.group_total for row in result} == dict(totals)


def test_running_total_starts_no_job_while_built(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "running total")
    running_total(df, "g", ["k"], "k")
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_running_total_of_nothing(spark):
    df = spark.createDataFrame([], "g string, k bigint, v decimal(18,2)")
    assert running_total(df, "g", ["k"], "v").collect() == []


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8])
def test_union_all_keeps_every_row(spark, count):
    frames = [spark.range(i, i + 1) for i in range(count)]
    assert [row.id for row in union_all(*frames).collect()] == list(range(count))
