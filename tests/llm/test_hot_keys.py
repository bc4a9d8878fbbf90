"""Joins on a key that holds most rows: adaptive execution must be able to split it."""

from __future__ import annotations

import random
import re
from importlib import import_module

import pytest
from pyspark.sql import functions as F

from ledgermill.llm import common
from ledgermill.llm.circulant import near_duplicates as circulant_duplicates
from ledgermill.llm.fuzzy_passages import fuzzy_repeats
from ledgermill.llm.jaccard import near_duplicates
from ledgermill.llm.suffix_dedup import SuffixDedup, digests
from ledgermill.llm.url_lists import apply_lists
from ledgermill.llm.warc import with_first_copy
from tests.test_plans import SKEW, settings

# Equal rows take little room once they are compressed.
SMALL = SKEW | {
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1k",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "1k",
    "spark__sql__adaptive__forceOptimizeSkewedJoin": "true",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def split_joins(llm_spark, monkeypatch):
    """The keys of joins that were split, of all that is stored and of the result."""
    keys = []

    def record(df):
        df.collect()
        for line in _plan(df).splitlines():
            if "Join(skew=true)" in line:
                keys.append(re.search(r"\[([a-z0-9_]+)#", line).group(1))

    def stored(df):
        record(df)
        return common.stored(df)

    for name in ("suffix_dedup", "jaccard", "fuzzy_passages", "warc", "url_lists", "circulant"):
        monkeypatch.setattr(import_module(f"ledgermill.llm.{name}"), "stored", stored)

    def of(make):
        with settings(llm_spark, **SMALL):
            record(make())
        return set(keys)

    return of


@pytest.fixture(scope="module")
def hot_docs(llm_spark):
    """Half of all texts are one text, a quarter near copies of it."""
    rng = random.Random(5)

    def words(n):
        return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]

    base = words(120)
    texts = [" ".join(base)] * 800
    for _ in range(400):
        near = list(base)
        near[rng.randrange(120)] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(words(120)) for _ in range(400)]
    rng.shuffle(texts)
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs.repartition(8)


def test_suffix_dedup(split_joins, llm_spark):
    rng = random.Random(7)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    # All texts hold one string of little more than the length sought, and so its gram.
    shared = words(31)[:210]
    rows = [(k, f"{words(50)} {shared} {words(5)}") for k in range(1600)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert "gram" in split_joins(lambda: digests(SuffixDedup().remove(docs)))


def test_ngram_jaccard(split_joins, hot_docs):
    assert "s1" in split_joins(lambda: near_duplicates(hot_docs))


def test_circulant(split_joins, hot_docs):
    assert "s1" in split_joins(lambda: circulant_duplicates(hot_docs))


def test_fuzzy_passages(split_joins, hot_docs):
    assert "seed" in split_joins(lambda: fuzzy_repeats(hot_docs))


def test_warc(split_joins, hot_docs):
    pages = hot_docs.select(
        F.col("doc_id").alias("page_id"),
        # Unlike in each row, as equal ones would be compressed away.
        F.concat_ws("/", *(F.sha2(F.concat("doc_id", F.lit(f" {k}")), 512) for k in range(6))).alias("url"),
        F.substring("text", 1, 60).alias("html"),
    )
    assert "payload_key" in split_joins(lambda: with_first_copy(pages))


def test_url_lists(split_joins, llm_spark):
    host = F.when(F.col("id") % 2 == 0, "hot.example.com").otherwise(F.concat("id", F.lit(".example.org")))
    captures = llm_spark.range(20_000, numPartitions=8).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://"), host, F.lit("/")).alias("url"),
        F.lit("2024-01-05").cast("date").alias("fetched_on"),
    )
    listed = [("hot.example.com", "block"), ("example.com", "allow"), ("7.example.org", "block")]
    entries = llm_spark.createDataFrame(
        [(p, a, "2024-01-01") for p, a in listed], "pattern string, action string, day string"
    ).withColumn("listed_on", F.col("day").cast("date"))
    assert "pattern" in split_joins(lambda: apply_lists(captures, entries))
