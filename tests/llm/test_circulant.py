from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgermill.llm import circulant
from ledgermill.llm.circulant import Circulant, near_duplicates
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS


def shingles(text):
    words = brute.SPACED.findall(brute.lower(text))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_force(rows):
    """Every row is a node of its own."""
    sets = [shingles(text) for _, text in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter()
    for ks in holders.values():
        shared.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    links = [p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    group = brute.components(range(len(rows)), links)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        ids = [i for i in (least.get(group[k]), doc_id) if i is not None]
        least[group[k]] = min(ids, default=None)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        component = least[group[k]] if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), component, doc_id == component))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, near_duplicates(docs).collect()), key=str)


@pytest.mark.parametrize("crowd", [0, 256])
def test_chains_families_and_templates(llm_spark, monkeypatch, crowd):
    monkeypatch.setattr(circulant, "CROWD", crowd)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    template = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(10):
        words = rng.choices(vocabulary, k=rng.choice([20, 40, 80]))
        for _ in range(rng.choice([1, 4, 12])):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    # Texts of one template with endings of their own, near the threshold on both sides.
    for _ in range(40):
        texts.append(" ".join(template + rng.choices(vocabulary, k=rng.choice([2, 5, 8, 20]))))
    texts += ODD_TEXTS
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute_force(rows)


def test_null_ids_repeats_clashing_columns_and_nothing(llm_spark):
    rows = [
        (None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (None, "x"), (2, None),
        (None, None), (2**62, "a b c d e f"), (-1, "p q"), (-1, "other words with one id here"),
    ]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs.selectExpr("*", "1 as row", "2 as key", "array(3L) as bands", "4 as n_shingles")
    assert found(wide) == brute_force(rows)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_coordinates_are_minima_of_one_shifted_permutation():
    c = Circulant(bits=8, width=10, seed=1)
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64))
    ring = np.append(c.shifted[:, 0], [])
    wanted = [
        min(ring[(int(c.first[int(k) >> 56]) + shift) % 256] for k in keys) for shift in range(10)
    ]
    assert c.signature(keys).tolist() == wanted


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    c = Circulant(width=200)
    for share in (0.5, 0.8, 0.95):
        near = []
        for _ in range(20):
            keys = rng.integers(0, 2**64, 2000, dtype=np.uint64)
            # Two sets of n with `both` in common: both / (2 n - both) = share.
            both = int(1000 * 2 * share / (1 + share))
            a, b = keys[:1000], np.concatenate([keys[:both], keys[1000 : 2000 - both]])
            near.append((c.signature(a) == c.signature(b)).mean())
        assert abs(np.mean(near) - share) < 0.02


def test_long_words_and_block_ends(monkeypatch):
    import pyarrow as pa

    from ledgermill.llm import common

    rng = random.Random(4)
    texts = [
        " ".join("x" * rng.choice([1, 3, 50]) + str(rng.randrange(30)) for _ in range(rng.randrange(60)))
        for _ in range(50)
    ]
    column = pa.array([*texts, None, "", "y" * 500, "Y" * 500])
    whole = [k.tolist() for k in circulant.shingle_sets(column)]
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    monkeypatch.setattr(circulant, "SHINGLE_BLOCK", 16)
    assert [k.tolist() for k in circulant.shingle_sets(column)] == whole
    assert whole[-1] == whole[-2]
    for text, keys in zip(texts, whole, strict=False):
        assert len(keys) == len(shingles(text))
