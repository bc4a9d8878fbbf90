"""Queries of this subpackage by name, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import circulant, merkle
from ledgermill.llm.byte_bpe import ByteBpe
from ledgermill.llm.common import ship
from ledgermill.llm.decontamination import decontaminate
from ledgermill.llm.fuzzy_passages import fuzzy_repeats
from ledgermill.llm.jaccard import near_duplicates
from ledgermill.llm.language import LanguageId, held_out
from ledgermill.llm.licenses import scan_licenses
from ledgermill.llm.quality import score_repetition
from ledgermill.llm.suffix_dedup import SuffixDedup, digests
from ledgermill.llm.url_lists import apply_lists, patterns_of
from ledgermill.llm.vector_codes import VectorCodes
from ledgermill.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(SuffixDedup().remove(docs))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_repeats(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return ByteBpe(spark, path, public_tokenizers.PATTERN).digests(docs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = LanguageId(docs).predict(docs)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_repetition(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def _number_of(pattern: Column) -> Column:
    """A number below 2^28 that stands for a pattern."""
    return F.conv(F.substring(F.md5(pattern), 1, 7), 16, 10).cast("long")


def listed(pages: DataFrame) -> DataFrame:
    """Dated list entries for the patterns of the pages, as a stand-in for published lists.

    Every pattern's entries follow from its digest: a third are blocked, removed and
    blocked again, a sixth are allowed for good, the rest are never listed.
    """
    patterns = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct()
    n = _number_of(F.col("pattern"))

    def entry(action: str, day: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("listed_on"))

    entries = F.when(
        n % 3 == 0,
        F.array(
            entry("block", n % 100), entry("remove", 100 + n % 97), entry("block", 200 + n % 89)
        ),
    ).when(n % 6 == 1, F.array(entry("allow", n % 300)))
    rows = patterns.select("pattern", F.explode(entries).alias("entry"))
    return rows.select("pattern", "entry.action", "entry.listed_on")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture. Pages hold no time of fetching; their id gives the day."""
    pages = _table(spark, sf_dir, "pages")
    # The remainder comes first, so that no id is too large to multiply.
    place = F.pmod(F.col("page_id"), F.lit(365)) * 7919 % 365
    day = F.date_add(F.lit("2024-01-01").cast("date"), place.cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched_on"))
    return apply_lists(captures, listed(pages))


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VectorCodes(_table(spark, sf_dir, "embeddings")).codes()


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_ngram_jaccard, op3_fuzzy_passages, op4_decontamination, op5_byte_bpe, op6_language_id, op7_warc, op8_quality_rules,
        op9_license_scan, op10_url_lists, op11_circulant_minhash, op12_merkle_manifest, op13_vector_codes,
    )
}
