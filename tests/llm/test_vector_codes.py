from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgermill.llm import vector_codes
from ledgermill.llm.vector_codes import AnchorTree, VectorCodes, choose_anchors


def brute(rows):
    """The contract over rows (vec_id, label, vector) that are kept, in plain Python numbers."""
    rows = [(i, label, [int(np.floor(np.float64(x) * 4096)) for x in v]) for i, label, v in rows]
    width = len(rows[0][2]) // 8
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
    books = [[r[2][p * width : (p + 1) * width] for r in start] for p in range(8)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    def parts(v):
        return [v[p * width : (p + 1) * width] for p in range(8)]

    for _ in range(6):
        groups = {}
        for _, _, v in rows:
            for p, x in enumerate(parts(v)):
                groups.setdefault((p, nearest(p, x)[1]), []).append(x)
        for (p, k), xs in groups.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    coded = []
    for i, label, v in rows:
        found = [nearest(p, x) for p, x in enumerate(parts(v))]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    numbers = ",".join(str(c) for book in books for e in book for c in e)
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((i, c, e, total[lb], digest) for i, lb, c, e in coded), key=str)


def found(df):
    return sorted((tuple(r) for r in VectorCodes(df).codes().collect()), key=str)


def test_embeddings_agree_with_brute_force(llm_spark, oracle_dir, monkeypatch):
    df = llm_spark.read.parquet(f"{oracle_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "label", "embedding").collect()]
    assert found(df) == brute(rows)


def test_nulls_ties_repeats_odd_lengths_and_clashing_columns(llm_spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    dropped = [
        (1, 1, None), (2, 1, [None] * 16), (3, 1, [0.0] * 15 + [nan]), (4, 1, [inf] + [0.0] * 15),
        (5, 1, [-inf] * 16), (6, 1, [0.0] * 15 + [None]), (60, 1, [0.5] * 8), (61, 1, []), (0, 1, [0.5] * 15),
    ]
    # Components on a coarse grid, so that many distances tie; some rows repeat.
    kept = [
        (rng.choice([None, 10, 11, k + 12]), rng.choice([None, 1, 2]), [rng.randrange(-3, 4) / 4 for _ in range(16)])
        for k in range(150)
    ]
    kept += kept[:20] * 3
    kept += [(7, None, [-0.0001] * 16)] * 50
    rows = dropped + kept
    rng.shuffle(rows)
    df = llm_spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    wide = df.selectExpr("*", "1 as code", "2 as error", "3 as vector", "4 as points")
    assert found(wide) == brute(kept)


def test_few_rows_and_none(llm_spark):
    rows = [(5, 1, [0.1] * 8), (4, 1, [0.2] * 8), (6, 2, [0.12] * 8)]
    df = llm_spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 0")) == []


@pytest.mark.parametrize("spread", [0, 1, 3, 2000])
def test_trees_agree_with_all_distances(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (700, 6))
    points[:100] = points[0]
    entries = np.concatenate([points[rng.integers(0, 700, 10)], points[:6]])
    tree = AnchorTree.from_bytes(AnchorTree(points).to_bytes())
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    nearest = far.argmin(axis=1)
    assert tree.nearest(points, entries).tolist() == nearest.tolist()
    total = tree.totals(points, entries)
    for k in range(len(entries)):
        own = points[nearest == k]
        assert total[k].tolist() == [*own.sum(axis=0).tolist(), len(own)]


def test_balls_hold_their_points_and_their_sums():
    points = np.random.default_rng(5).integers(-500, 500, (1000, 4))
    tree = AnchorTree(points)
    assert sorted(tree.order.tolist()) == list(range(1000))
    assert (tree.low[-1], tree.high[-1]) == (0, 1000)
    for a, b, left, right, c, r, s in zip(
        tree.low, tree.high, tree.left, tree.right, tree.centre, tree.radius, tree.sums, strict=True
    ):
        own = points[tree.order[a:b]]
        assert (np.sqrt(((own - c) ** 2).sum(axis=1)) <= r + 1e-9).all()
        assert own.sum(axis=0).tolist() == s.tolist()
        if left >= 0:
            assert (tree.low[left], tree.high[left], tree.low[right], tree.high[right]) == (a, tree.high[left], tree.high[left], b)
        else:
            assert b - a <= vector_codes.LEAF or r == 0


def test_well_parted_balls_are_owned_whole():
    rng = np.random.default_rng(6)
    centres = rng.integers(-10**5, 10**5, (16, 8))
    points = (centres[:, None] + rng.integers(-50, 50, (16, 200, 8))).reshape(-1, 8)
    balls, _, rest, _ = AnchorTree(points).owners(points, centres)
    assert len(rest) == 0 and len(balls) < 200


def test_points_have_their_nearest_anchor():
    points = np.random.default_rng(7).integers(-99, 99, (300, 3))
    owner = choose_anchors(points, 12)
    assert owner.max() == 11
