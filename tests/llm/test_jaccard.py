from __future__ import annotations

import random

from ledgermill.llm.components import smallest_reachable
from ledgermill.llm.jaccard import choose_matches, near_duplicates
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS

import numpy as np


def _found(docs):
    return sorted(map(tuple, near_duplicates(docs).collect()))


def test_components_agree_with_brute_force(documents, texts):
    assert _found(documents) == brute.near_duplicates(texts)


def test_odd_texts(odd_docs):
    assert _found(odd_docs) == brute.near_duplicates(list(enumerate(ODD_TEXTS)))


def test_chains_families_and_shared_passages(llm_spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = rng.choices(vocabulary, k=25)
    texts = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([20, 40, 60]))
        for _ in range(rng.choice([1, 3, 12])):
            # Each text is a changed copy of the one before, so that chains drift.
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join([*words, *shared] if rng.random() < 0.5 else words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    wanted = brute.near_duplicates(rows)
    assert len({r[2] for r in wanted}) < len(rows)
    assert _found(llm_spark.createDataFrame(rows, "doc_id long, text string")) == wanted


def test_null_ids_repeats_and_nothing(llm_spark):
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (None, "x"), (2, None)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (2, 0, 2)]))
    assert near_duplicates(docs.limit(0)).collect() == []


def test_smallest_reachable(llm_spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2050)]
    frame = llm_spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    nodes = {n for pair in links for n in pair}
    wanted = {n: r for n, r in brute.components(nodes, links).items() if n != r}
    assert dict(map(tuple, smallest_reachable(frame).collect())) == wanted


def test_matches_asked_for_follow_cost():
    assert choose_matches(np.ones(100, np.int64), 100) == 1
    crowded = np.concatenate([np.full(21, 1000), np.ones(79, np.int64)])
    assert choose_matches(crowded, 100) > 1
    assert choose_matches(np.array([9]), 1) == 1
