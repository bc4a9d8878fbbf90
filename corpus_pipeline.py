"""The corpus pipeline: stages in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). Its rows are written as Parquet in the shared
folder and read again by the next, so a lost executor costs at most the stage at hand.
All stages but the last return the columns of ``documents``. Null and empty texts go in
the first stage; null doc_ids, repeated rows and clashing columns are as each operator
says; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.byte_bpe import ByteBpe
from ledgermill.llm.common import ship, stored
from ledgermill.llm.decontamination import without_hits
from ledgermill.llm.jaccard import near_duplicates
from ledgermill.llm.language import UNKNOWN, LanguageId
from ledgermill.llm.suffix_dedup import SuffixDedup

# Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns but doc_id and text numbered, so that none clashes with those
    that an operator adds."""
    names = [c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names)


def _named(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` under their names from ``rows``, which has them numbered."""
    own = _apart(docs).columns
    return rows.select(
        *(new.get(c, F.col(o)).alias(c) for c, o in zip(docs.columns, own, strict=True))
    )


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network is sure of."""
    ship(spark)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return _named(LanguageId(docs).predict(_apart(docs)).where(sure), docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates, that with the least id.

    A row stands by a hash of its id and text, so rows without an id and unlike texts of one
    id are near-duplicates by their texts only. Of a group a null id comes last, and of rows
    that repeat id and text one is kept.
    """
    ship(spark)
    row = F.xxhash64("doc_id", "text").alias("_row")
    texts = docs.select(row, "doc_id", "text")
    groups = near_duplicates(texts.select(F.col("_row").alias("doc_id"), "text"))
    groups = groups.groupBy(F.col("doc_id").alias("_row")).agg(
        F.min("component_id").alias("group"), F.count("*").alias("copies")
    )
    ids = texts.select("_row", "doc_id").groupBy("_row").agg(F.min("doc_id").alias("id"))
    groups = stored(groups.join(ids, "_row"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("first")
    firsts = groups.groupBy("group").agg(first, F.count("*").alias("members"))
    firsts = stored(firsts.where("members > 1").select("group", F.col("first._row").alias("kept")))
    marked = groups.join(firsts, "group", "left")
    others = marked.where("_row <> kept").select("_row")
    repeated = marked.where("copies > 1 and (kept is null or _row = kept)").select("_row")
    left = _apart(docs).withColumn("_row", row).join(stored(others), "_row", "left_anti")
    repeated = stored(repeated)
    once = left.join(repeated, "_row", "left_anti")
    again = left.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return _named(once.unionByName(again), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of 200 bytes out of the texts; documents of nothing else go."""
    ship(spark)
    cut = SuffixDedup().remove(_apart(docs), as_text=True).where("kept_text <> ''")
    text = F.col("kept_text")
    return _named(cut, docs, text=text, n_chars=F.length(text).cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window of words with a benchmark item."""
    ship(spark)
    return without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, decoded again as a check."""
    ship(spark)
    bpe = ByteBpe(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.encode(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
        "decodes",
    )


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# The first stage rests on a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir))
    return rows


QUERIES = {"pipeline": run}
