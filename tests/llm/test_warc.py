from __future__ import annotations

import os
from collections import defaultdict

import pytest
from pyarrow import fs

from ledgermill.llm import warc


def _wanted(pages):
    first = {}
    for page, html in pages:
        known = first.setdefault(html or "", page)
        if known is None or (page is not None and page < known):
            first[html or ""] = page
    rows = []
    for page, html in pages:
        data = (html or "").encode()
        lead = first[html or ""]
        kind = "response" if page == lead else "revisit"
        rows.append(
            (page, len(data), warc.base32_sha1(data), kind, None if page == lead else lead)
        )
    return sorted(rows, key=str)


def _got(frame):
    rows = frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, rows.collect()), key=str)


def test_round_trip_of_pages(llm_spark, oracle_dir):
    pages = llm_spark.read.parquet(f"{oracle_dir}/pages.parquet")
    rows = pages.select("page_id", "url", "html").collect()
    read = warc.round_trip(pages)
    assert _got(read) == _wanted([(r[0], r[2]) for r in rows])
    urls = {r[0]: r[1] for r in rows}
    assert all(urls[r.page_id] == r.url for r in read.collect())


def test_copies_nulls_and_long_pages(llm_spark):
    long = "".join(map(chr, range(0x100, 0x3000))) * 60
    rows = [
        (5, "http://a/", "same"), (2, "http://b/%0A\r\nX: y", "same"), (9, None, "same"),
        (None, "u", "same"), (None, "u", None), (7, "u", ""), (3, "u", None), (8, "é", long),
        (4, "u", "twice"), (4, "u", "twice"), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    ]
    pages = llm_spark.createDataFrame(
        [(*r, "x") for r in rows], "page_id long, url string, html string, payload string"
    )
    read = warc.round_trip(pages)
    assert _got(read) == _wanted([(r[0], r[2]) for r in rows])
    got = {(r.page_id, r.url): r.payload for r in read.collect()}
    assert got[8, "é"].decode() == long
    assert (2, "http://b/%0A\r\nX: y") in got
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("step", [1, 7, 1000, 10**6])
def test_every_record_belongs_to_the_range_it_starts_in(tmp_path, step):
    payloads = [os.urandom(k * 90).hex().encode() for k in range(40)]
    # Bytes that look like a member, stored where a reader may come across them.
    payloads[3] = warc.MAGIC + os.urandom(50) + warc.record(1, "u", b"inner", 1)
    members = [warc.record(k, None, p, k) for k, p in enumerate(payloads)]
    junk = [b"", warc.MAGIC, b"\x1f\x8b"]
    data = b"".join(m + junk[k % 3] for k, m in enumerate(members[:6])) + b"".join(members[6:])
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    found = defaultdict(list)
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        for start in range(0, len(data), max(step, len(data) // 3000)):
            end = min(start + max(step, len(data) // 3000), len(data))
            for content in warc.read_range(file, len(data), start, end):
                found[warc.parse_record(content)[0]].append(warc.parse_record(content)[-1])
    assert {k: [p] for k, p in enumerate(payloads)} == found


def test_long_headers_come_back_wherever_a_read_ends(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 70_000)
    urls = [os.urandom(n).hex() for n in (10, 150_000, 20, 400_000)]
    data = b"".join(warc.record(k, u, b"page", k) for k, u in enumerate(urls))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        read = [warc.parse_record(c)[1] for c in warc.read_range(file, len(data), 0, len(data))]
    assert read == urls
