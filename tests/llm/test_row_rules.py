from __future__ import annotations

from ledgermill.llm import quality
from ledgermill.llm.decontamination import decontaminate
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS


def _rules(rows):
    return [
        (i, *brute.quality(t, quality.REPEAT_SHARES, quality.LINE_SHARE, quality.LINE_CHAR_SHARE))
        for i, t in rows
    ]


def _score(docs):
    rows = quality.score_repetition(docs).drop("dup_line_chars", "repeat_chars")
    return sorted(map(tuple, rows.collect()))


def test_rules_agree_with_brute_force(documents, texts):
    assert _score(documents) == _rules(texts)


def test_rules_on_odd_texts(odd_docs):
    assert _score(odd_docs) == _rules(list(enumerate(ODD_TEXTS)))


def test_rules_on_null_ids_repeats_and_nothing(llm_spark):
    rows = [(None, "x " * 20), (1, "x " * 20), (1, "x " * 20)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.score_repetition(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert len({tuple(r)[1:6] for r in got}) == 1
    assert quality.score_repetition(docs.limit(0)).collect() == []


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_hits_agree_with_brute_force(llm_spark, documents, texts, oracle_dir):
    items = llm_spark.read.parquet(f"{oracle_dir}/benchmark.parquet")
    wanted = brute.decontaminate(texts, [tuple(r) for r in items.collect()])
    assert any(r[5] for r in wanted)
    assert sorted(map(tuple, decontaminate(documents, items).collect())) == wanted
    # Several passes give what one gives.
    in_blocks = decontaminate(documents, items, block_bytes=3000)
    assert sorted(map(tuple, in_blocks.collect())) == wanted


def test_hits_on_odd_texts_and_short_items(llm_spark, odd_docs):
    rows = [
        (3, "a b c d e f g h i j k", 0), (3, "CC BY!", 0), (20, "café", 0), (5, "", 0),
        (6, None, 0), (None, "one", 0), (7, "10 of them; and some", 0), (100, "a.b.c", 0),
        (100, "a.b.c", 0), (9, "overall long words 10 of them and some more words", 0),
    ]
    items = [(r[0], r[1]) for r in rows if r[0] is not None]
    wanted = brute.decontaminate(list(enumerate(ODD_TEXTS)), items)
    got = decontaminate(odd_docs, _items(llm_spark, rows)).collect()
    assert sorted(map(tuple, got)) == wanted


def test_nothing_to_find_or_to_search(llm_spark, odd_docs):
    none = _items(llm_spark, [])
    assert not any(r.contaminated for r in decontaminate(odd_docs, none).collect())
    some = _items(llm_spark, [(1, "a b", 0)])
    assert decontaminate(odd_docs.limit(0), some).collect() == []
