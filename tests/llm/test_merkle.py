from __future__ import annotations

import hashlib
import random
import zlib

from ledgermill.llm.merkle import MerkleTree, manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n_chars = n_chars if n_chars is None else n_chars + more
    values = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    upper = tree([trees[lang][-1][0] for lang in order])
    root = upper[-1][0]

    def climb(levels, place, digest, siblings):
        for level in levels[:-1]:
            pair = level[place & ~1 : (place & ~1) + 2]
            siblings += [x for k, x in enumerate(pair) if k != place & 1]
            pair[place & 1] = digest
            digest = h("".join(pair))
            place >>= 1
        return digest

    out = []
    for g, lang in enumerate(order):
        for place, row in enumerate(groups[lang]):
            change = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            siblings = []
            start = leaf(row, 1) if change else leaf(row)
            top = climb(trees[lang], place, start, siblings)
            top = climb(upper, g, top, siblings)
            proof = h("".join(siblings))
            subroot = trees[lang][-1][0]
            out.append((row[0], leaf(row), subroot, root, proof, top, top == root))
    return sorted(out, key=str)


def found(docs, levels):
    return sorted((tuple(r) for r in manifest(docs, MerkleTree(levels)).collect()), key=str)


def test_documents_agree_with_brute_force(documents):
    rows = documents.select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = found(documents, 4)
    assert got == brute([tuple(r) for r in rows])
    assert {r[6] for r in got} == {True, False}


def test_nulls_repeats_odd_groups_and_nothing(llm_spark):
    rng = random.Random(3)
    rows = [(None, None, None, None, None), (7, "s", "", 1, ""), (2**62, "ü", "é", -5, "x" * 300_000)]
    rows += [(9, "s", "en", 2**63 - 1, "same")] * 9 + [(9, "s", "en", 3, "other")]
    rows += [(None, "s", "en", 4, "no id"), (-3, None, "zz", 4, None)]
    rows += [(rng.randrange(99), "s", lang, None, "t") for lang in ("a", "b", "B") for _ in range(5)]
    rng.shuffle(rows)
    docs = llm_spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as grp", "1 as pos", "2 as n")
    assert found(docs, 1) == brute(rows)
    assert manifest(docs.limit(0)).collect() == []


def test_one_row_is_its_own_root(llm_spark):
    row = (1, "s", "en", 3, "abc")
    (got,) = manifest(llm_spark.createDataFrame([row], COLUMNS)).collect()
    assert (got.leaf, got.subroot, got.root) == (leaf(row),) * 3
    assert got.proof_sha256 == h("") and got.verified


def test_a_changed_row_changes_the_root(llm_spark):
    rows = [(k, "s", "en", 1, f"t{k}") for k in range(20)]
    roots = set()
    for text in ("t3", "t3 changed"):
        rows[3] = (3, "s", "en", 1, text)
        docs = llm_spark.createDataFrame(rows, COLUMNS)
        roots |= {r.root for r in manifest(docs, MerkleTree(3)).collect()}
    assert len(roots) == 2
