from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgermill.llm.byte_bpe import ByteBpe, Codec
from tests.llm.conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return Codec(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def _ids(codec, text):
    return [x for part in codec.encode(text) for x in part]


def _digests(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    data = library.decode_bytes(ids)
    joined = ",".join(map(str, ids)).encode()
    return doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(data).hexdigest()


def test_digests_of_documents(llm_spark, documents, texts, library):
    bpe = ByteBpe(llm_spark, PATH, public_tokenizers.PATTERN)
    got = sorted(map(tuple, bpe.digests(documents).collect()))
    assert got == [_digests(library, i, t) for i, t in texts]


def test_odd_texts_go_there_and_back(llm_spark, odd_docs, library):
    bpe = ByteBpe(llm_spark, PATH, public_tokenizers.PATTERN)
    assert sorted(map(tuple, bpe.digests(odd_docs).collect())) == [
        _digests(library, i, t) for i, t in enumerate(ODD_TEXTS)
    ]
    rows = bpe.decode(bpe.encode(odd_docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == [t or "" for t in ODD_TEXTS]
    assert all(r.decoded_valid and r.kept for r in rows)
    assert bpe.decode(bpe.encode(odd_docs.limit(0))).collect() == []


def test_machine_makes_what_the_merges_make(codec, library):
    rng = random.Random(3)
    tokens = list(codec.machine.ranks)
    for _ in range(3000):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6)))
        assert list(codec.machine.encode(data)) == library._core_bpe.encode_single_piece(data)
    for _ in range(500):
        text = "".join(rng.choice("abcdethinrs é中\U0001f600 \n") for _ in range(200))
        assert _ids(codec, text) == library.encode_ordinary(text)


def test_full_tables_are_emptied_and_change_nothing(codec, library, monkeypatch, texts):
    monkeypatch.setattr("ledgermill.llm.byte_bpe.MAX_STATES", 50)
    monkeypatch.setattr("ledgermill.llm.byte_bpe.MAX_PAIRS", 20)
    monkeypatch.setattr("ledgermill.llm.byte_bpe.MAX_PIECES", 30)
    for _, text in texts[:40]:
        assert _ids(codec, text) == library.encode_ordinary(text)


def test_decoder_holds_back_unfinished_characters(codec):
    text = "aé中\U0001f600z"
    machine = codec.machine
    single = [machine.ranks[bytes([b])] for b in text.encode()]
    decoder, parts = codec.decoder(), []
    for token in single:
        part = decoder.feed([token])
        part.decode()
        parts.append(part)
    assert b"".join(parts).decode() == text and decoder.finish() == b"" and decoder.valid
    for bad in (b"\xc3", b"\xff", b"\xed\xa0\x80", b"a\xe4\xb8", b"\xc0\x80"):
        decoder = codec.decoder()
        data = decoder.feed([machine.ranks[bytes([b])] for b in bad]) + decoder.finish()
        assert data == bad and not decoder.valid


def test_memory_of_a_task_is_returned(monkeypatch):
    from ledgermill.llm import byte_bpe

    called = []

    class Library:
        @staticmethod
        def malloc_trim(left):
            called.append(left)

    monkeypatch.setattr("ctypes.CDLL", lambda name: Library)
    byte_bpe._forget()
    assert called == [0]
