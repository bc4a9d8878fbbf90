from __future__ import annotations

from datetime import date

from ledgermill.llm.queries import op10_url_lists
from ledgermill.llm.url_lists import apply_lists


def _day(n):
    return date(2024, 1, n)


def _apply(spark, captures, entries):
    frame = spark.createDataFrame(
        [(*c, "x") for c in captures], "page_id long, url string, fetched_on date, verdict string"
    )
    lists = spark.createDataFrame(
        [(*e, "x") for e in entries], "pattern string, action string, listed_on date, url string"
    )
    rows = apply_lists(frame, lists).collect()
    return sorted(((r.page_id, r.verdict, r.pattern, r.since) for r in rows), key=str)


def test_the_active_and_most_telling_entry_decides(llm_spark):
    entries = [
        ("example.com", "block", _day(5)), ("example.com", "remove", _day(10)),
        ("example.com", "block", _day(20)), ("a.example.com", "allow", _day(6)),
        ("a.example.com/bad", "block", _day(6)), ("b.example.com", "allow", _day(7)),
        ("b.example.com", "block", _day(7)), ("b.example.com", "block", _day(7)),
        (None, "block", _day(1)), ("x.org", "block", None), ("com", "block", _day(1)),
    ]
    captures = [
        (1, "http://example.com/", _day(4)), (2, "http://example.com/", _day(5)),
        (3, "http://www.EXAMPLE.com:80?x", _day(9)), (4, "http://example.com", _day(10)),
        (5, "http://a.example.com/good/bad", _day(8)), (6, "https://a.example.com/bad/x", _day(8)),
        (7, "http://u@b.example.com/", _day(7)), (8, "http://b.example.com/", _day(6)),
        (9, None, _day(6)), (10, "not a url", _day(6)), (11, "http://x.org/", _day(6)),
        (12, "http://example.com/", None), (13, "http://deep.b.example.com/p", _day(30)),
        (None, "http://example.com/", _day(20)), (2, "http://example.com/", _day(5)),
    ]
    block = ("block", "example.com")
    assert _apply(llm_spark, captures, entries) == sorted(
        [
            (1, "none", None, None), (2, *block, _day(5)), (3, *block, _day(5)),
            (4, "none", None, None), (5, "allow", "a.example.com", _day(6)),
            (6, "block", "a.example.com/bad", _day(6)), (7, "block", "b.example.com", _day(7)),
            (8, *block, _day(5)), (9, "none", None, None), (10, "none", None, None),
            (11, "none", None, None), (12, "none", None, None),
            (13, "block", "b.example.com", _day(7)), (None, *block, _day(20)), (2, *block, _day(5)),
        ],
        key=str,
    )


def test_nothing_listed_and_nothing_captured(llm_spark):
    one = [(1, "http://a.b/", _day(1))]
    assert _apply(llm_spark, one, []) == [(1, "none", None, None)]
    assert _apply(llm_spark, [], [("a.b", "block", _day(1))]) == []


def test_pages_of_any_id(llm_spark, tmp_path):
    ids = [2**62, -(2**62), 2**63 - 1, -7, 0, None]
    pages = [(i, "http://a.example.com/x", "<p>", "v") for i in ids] + [(5, None, None, None)]
    schema = "page_id long, url string, html string, verdict string"
    llm_spark.createDataFrame(pages, schema).write.parquet(str(tmp_path / "pages.parquet"))
    rows = op10_url_lists(llm_spark, str(tmp_path)).collect()
    assert sorted((r.page_id for r in rows), key=str) == sorted([*ids, 5], key=str)
    assert {r.fetched_on for r in rows if r.page_id in (0, None)} == {date(2024, 1, 1), None}
