from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from ledgermill.llm import suffix_dedup
from ledgermill.llm.suffix_dedup import SuffixDedup, digests
from tests.llm.conftest import ODD_TEXTS


def _wanted(rows, length):
    count = Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(hash(data[i : i + length]) for i in range(len(data) - length + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        last = 0
        for i in range(len(data) - length + 1):
            if count[hash(data[i : i + length])] > 1:
                begin = max(i, last)
                gone[begin : i + length] = b"\1" * (i + length - begin)
                last = i + length
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        digest = hashlib.sha256(left).hexdigest()
        out.append((doc_id, len(data), sum(gone), spans, digest))
    return sorted(out, key=str)


def _got(docs, length=200, **more):
    return sorted(map(tuple, digests(SuffixDedup(length, **more).remove(docs)).collect()), key=str)


def test_documents_agree_with_brute_force(documents, texts):
    wanted = _wanted(texts, 200)
    assert any(r[2] for r in wanted) and _got(documents) == wanted


def test_odd_texts(odd_docs):
    assert _got(odd_docs) == _wanted(list(enumerate(ODD_TEXTS)), 200)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_passages_periods_and_edges(llm_spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(11)
    words = ["é", "ab", "\0", "x", "yz ", "ü0"]
    pool = ["".join(rng.choices(words, k=rng.randrange(5, 40))) for _ in range(12)]
    rows = [(k, "".join(rng.choices(pool, k=rng.randrange(1, 6)))) for k in range(60)]
    rows += [(100, "a" * 90), (101, "a" * 20), (102, "ab" * 50), (None, "a" * 21), (103, pool[0])]
    rows += [(103, pool[0]), (104, pool[0] * 3), (None, None), (105, "b" * 19)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(docs, 20) == _wanted(rows, 20)


def test_merge_keeps_to_whole_strings():
    rows = [b"abcdXYZWefgh", b"bcdXYZWefg", b"XYZWefgh", b"cdXYZWqq"]
    table = suffix_dedup.merge_contexts(rows, [4, 3, 0, 2], 8, 4)
    assert table.tolist() == [
        [False, True, True, True, True],
        [False, True, True, True, False],
        [False, False, False, False, True],
        [False, False, False, False, False],
    ]


def test_nothing(llm_spark):
    assert _got(llm_spark.createDataFrame([], "doc_id long, text string")) == []
