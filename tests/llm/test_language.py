from __future__ import annotations

import zlib

import numpy as np
import pytest

from ledgermill.llm import language
from ledgermill.llm.language import LanguageId, held_out
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def model(documents):
    return LanguageId(documents)


def test_held_out_documents_are_named_right(documents, model):
    rows = model.predict(documents.withColumn("held", held_out())).collect()
    assert {r.doc_id for r in rows if r.held} == {
        r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    }
    held = [r for r in rows if r.held]
    right = sum(r.lang_pred == r.lang for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(odd_docs, model):
    rows = model.predict(odd_docs).orderBy("doc_id").collect()
    assert len(rows) == len(ODD_TEXTS) and all(r.kept for r in rows)
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3
    assert rows[0].score == 0 and rows[5].lang_pred in model.network.langs
    assert (rows[7].lang_pred, rows[7].score) == (rows[9].lang_pred, rows[9].score)


def test_nothing_to_learn_from_and_nothing_to_predict(llm_spark, documents, model):
    rows = [(None, "text", "en"), (1, "text", None), (2, None, "en")]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = LanguageId(docs).predict(docs).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert model.predict(documents.limit(0)).collect() == []


def test_gradients_are_those_of_the_loss():
    network = language.new_network(["a", "b", "c"])
    for w in network.arrays():
        w *= 3
    rng = np.random.default_rng(0)
    steps = rng.integers(0, 256, (6, 5, language.STRIDE)).astype(np.uint8)
    mask = np.ones((6, 5), np.float32)
    mask[4:, 1] = 0
    labels = np.array([0, 1, 2, 0, 1])

    def loss():
        states = [
            language._run(d, steps, mask, order, False)[0]
            for d, order in ((network.forward, range(6)), (network.backward, reversed(range(6))))
        ]
        p = language._softmax(np.concatenate(states, axis=2) @ network.out + network.out_bias)
        own = p[:, np.arange(5), labels].astype(np.float64)
        return -(np.log(own) * mask).sum() / mask.sum()

    grads = language._gradients(network, steps, mask, labels)
    for w, g in zip(network.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = w[at].copy(), 2e-3
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(g[at]), rel=0.05, abs=1e-4)
