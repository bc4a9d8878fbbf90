from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from ledgermill.llm.common import stored
from tests.llm import brute
from tests.llm.test_suffix_dedup import _wanted


def test_each_stage_agrees_with_brute_force_on_its_input(llm_spark, oracle_dir):
    docs = llm_spark.read.parquet(f"{oracle_dir}/documents.parquet")
    columns = docs.columns
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = stored(stage(llm_spark, docs, oracle_dir))
        assert name == "byte_bpe" or docs.columns == columns
    given["end"] = docs

    def rows(name):
        return [tuple(r) for r in given[name].select("doc_id", "text").collect()]

    first = rows("language_id")
    assert len(rows("ngram_jaccard")) >= 0.97 * len(first)
    before = rows("ngram_jaccard")
    kept = {i for i, _, root in brute.near_duplicates(before) if i == root}
    assert {i for i, _ in rows("suffix_dedup")} == kept
    cut = {r[0]: r[2] for r in _wanted(rows("suffix_dedup"), 200)}
    source, after = dict(rows("suffix_dedup")), dict(rows("decontamination"))
    assert any(cut.values())
    for i, n in cut.items():
        whole = len(source[i].encode())
        if n == whole:
            assert i not in after
        else:
            # Rests of characters cut through go as well.
            assert whole - n - 6 * 20 <= len(after[i].encode()) <= whole - n
    items = [tuple(r) for r in llm_spark.read.parquet(f"{oracle_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.decontaminate(rows("decontamination"), items) if not r[5]}
    assert {i for i, _ in rows("byte_bpe")} == clean
    end = docs.collect()
    assert {r.doc_id for r in end} == clean and all(r.decodes for r in end)


def test_empty_and_odd_documents(llm_spark, oracle_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "kept")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm_spark, docs, oracle_dir)
    assert all(r.decodes for r in docs.collect())
    docs = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm_spark, docs, oracle_dir)
    assert docs.collect() == []


def test_one_of_repeated_rows_and_null_ids_comes_out(llm_spark, oracle_dir):
    rng = random.Random(3)

    def text(n=120):
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))

    twice, copied, alone, near, one, other = (text() for _ in range(6))
    rows = [
        (1, twice), (1, twice), (2, copied), (None, copied), (None, alone), (None, alone),
        (3, near), (None, near + " more"), (4, one), (4, other), (5, None), (6, ""), (7, text()),
    ]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    kept = stored(corpus_pipeline.ngram_jaccard(llm_spark, docs, oracle_dir))
    wanted = [rows[k] for k in (0, 2, 4, 6, 8, 9, 10, 11, 12)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(wanted, key=str)
    cut = corpus_pipeline.suffix_dedup(llm_spark, kept.withColumn("n_chars", F.length("text")), oracle_dir)
    clean = [r for r in wanted if r[1]]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(clean, key=str)


def test_columns_named_like_those_of_operators_pass_through(llm_spark, oracle_dir):
    rng = random.Random(9)
    english = llm_spark.read.parquet(f"{oracle_dir}/documents.parquet").where("n_chars > 900")
    texts = [r.text for r in english.select("text", "doc_id").orderBy("doc_id").limit(6).collect()]
    names = [
        "ranges", "removed_ranges", "_row", "lang_pred", "score", "kept_text", "n_removed", "group",
        "copies", "own_0", "span_doc", "row", "kept",
    ]
    ids = [None, -5, 2**62, 3, -(2**62), 4]
    rows = [
        (i, t, "en" if k % 2 else "de", *(f"{n} {k}" for n in names))
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    rng.shuffle(rows)
    ddl = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    docs = llm_spark.createDataFrame(rows, ddl)
    given = {r[0]: r[2:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(llm_spark, docs, oracle_dir))
        assert docs.columns == ["doc_id", "text", "lang", *names]
        for r in docs.collect():
            assert tuple(r)[2:] == given[r.doc_id]
