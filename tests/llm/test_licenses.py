from __future__ import annotations

import re

from ledgermill.llm import licenses
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS

NOTICES = [
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0!",
    "cc by cc by\ncc. BY all rights reserved",
    "This work is licensed under the GNU General\nPublic License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of it",
    "Kirk CC Bİ cc bİy All Rights Reserved.",
    "licensed under the apache license version",
]


def _wanted(doc_id, text):
    low = brute.lower(text)
    words = brute.LETTERS.findall(low)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    found, best = set(base), 0.0
    for block in re.split(r"[\r\n]+|[.!?;][ \t\n\x0B\f\r]+", low):
        have = set(brute.LETTERS.findall(block))
        for template, label in licenses.TEMPLATES.items():
            own = set(template.split())
            if 100 * len(own & have) >= 80 * len(own):
                found.add(label)
                best = max(best, len(own & have) / len(own))
    return (
        doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if places else best,
    )


def test_scan_of_documents(documents, texts):
    got = sorted(map(tuple, licenses.scan_licenses(documents).collect()))
    wanted = [_wanted(i, t) for i, t in texts]
    assert got == wanted and any(r[2] for r in wanted)


def test_odd_texts_and_notices(llm_spark, odd_docs):
    assert sorted(map(tuple, licenses.scan_licenses(odd_docs).collect())) == [
        _wanted(i, t) for i, t in enumerate(ODD_TEXTS)
    ]
    rows = [(i, t) for i, t in enumerate(NOTICES)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan_licenses(docs).collect()))
    assert got == [_wanted(i, t) for i, t in rows]
    assert "mit" in got[3][6] and got[4][2] == 1
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_plan_has_no_python_and_no_shuffle(documents):
    plan = licenses.scan_licenses(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
