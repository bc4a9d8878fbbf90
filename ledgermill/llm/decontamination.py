"""Benchmark decontamination by winnowing: minimum k-gram hash per window, joined and extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import (
    LETTER_WORD,
    LOWER,
    expand,
    gram_hashes,
    slices,
    span_hashes,
    stored,
    text_buffers,
    words_of,
)

WINDOW = 10
GRAM = 5
# Text of items that one pass over the documents looks for. More items mean more passes.
BLOCK_BYTES = 16 * 1024 * 1024


@dataclass
class Items:
    """Windows of a block of items, sorted by hash, and the fingerprints kept of them."""

    fingerprints: np.ndarray
    hashes: np.ndarray
    texts: list[bytes]
    item_ids: list[list[int]]


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Starts of the k-grams that hold the least hash of any ``window`` words in one text.

    ``hashes`` are those of all k-grams, ``first`` the first word of each text. Equal
    spans of ``window`` words keep equal k-grams, as a window's choice rests on it alone.
    """
    per_window = window - k + 1
    counts = np.maximum(np.diff(first) - window + 1, 0)
    starts = expand(first[:-1], counts)
    if not len(starts):
        return starts
    least = hashes[starts].copy()
    at = starts.copy()
    for step in range(1, per_window):
        other = hashes[starts + step]
        smaller = other < least
        least[smaller] = other[smaller]
        at[smaller] = starts[smaller] + step
    return np.unique(at)


def _words(column: pa.Array):
    data, offsets = text_buffers(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, LETTER_WORD)
    return data, starts, ends, first, span_hashes(data, starts, ends)


def compile_items(ids: list[int], texts: list[str]) -> dict[int, Items]:
    """The windows of items by their length in words: ``WINDOW``, or that of a shorter item."""
    data, starts, ends, first, hashes = _words(pa.array(texts, pa.large_string()))
    n_words = np.diff(first)
    compiled = {}
    for length in sorted({min(int(n), WINDOW) for n in n_words if n}):
        mine = n_words >= WINDOW if length == WINDOW else n_words == length
        counts = np.where(mine, n_words - length + 1, 0)
        at = expand(first[:-1], counts)
        owner = np.repeat(np.arange(len(ids)), counts)
        windows: dict[bytes, tuple[int, set[int]]] = {}
        keys = gram_hashes(hashes, length)
        for p, item in zip(at.tolist(), owner.tolist(), strict=True):
            text = _join(data, starts, ends, p, length)
            windows.setdefault(text, (int(keys[p]), set()))[1].add(ids[item])
        rows = sorted((key, text, sorted(found)) for text, (key, found) in windows.items())
        k = min(GRAM, length)
        grams = gram_hashes(hashes, k)
        # Winnowed in each window by itself, which gives what winnowing the item gives.
        kept = winnow(grams, np.concatenate([[0], np.cumsum(n_words)]), k, length)
        of = np.searchsorted(first, kept, side="right") - 1
        compiled[length] = Items(
            np.unique(grams[kept[mine[of]]]),
            np.array([key for key, _, _ in rows], np.uint64),
            [text for _, text, _ in rows],
            [found for _, _, found in rows],
        )
    return compiled


def _join(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(at, at + n))


def find_hits(
    column: pa.Array, compiled: dict[int, Items]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """First word of each text, first byte of each word, which words are hit, items per text."""
    data, starts, ends, first, hashes = _words(column)
    hit = np.zeros(len(starts) + 1, np.int64)
    found: list[set[int]] = [set() for _ in range(len(first) - 1)]
    for length, items in compiled.items():
        k = min(GRAM, length)
        grams = gram_hashes(hashes, k)
        kept = winnow(grams, first, k, length)
        kept = kept[_among(grams[kept], items.fingerprints)]
        # Extend: every window that holds a shared fingerprint.
        around = np.unique(expand(kept - (length - k), np.full(len(kept), length - k + 1)))
        around = around[around >= 0]
        text = np.searchsorted(first, around, side="right") - 1
        inside = around + length <= first[np.minimum(text + 1, len(first) - 1)]
        around, text = around[inside], text[inside]
        keys = gram_hashes(hashes, length)[around]
        low = np.searchsorted(items.hashes, keys, side="left")
        high = np.searchsorted(items.hashes, keys, side="right")
        for p, t, a, b in zip(*(x[high > low].tolist() for x in (around, text, low, high)), strict=True):
            words = _join(data, starts, ends, p, length)
            for w in range(a, b):
                if items.texts[w] == words:
                    hit[p] += 1
                    hit[p + length] -= 1
                    found[t].update(items.item_ids[w])
    return first, starts, np.cumsum(hit)[:-1] > 0, found


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def item_blocks(
    benchmark: DataFrame, block_bytes: int = BLOCK_BYTES
) -> Iterator[dict[int, Items]]:
    """The items compiled in blocks of bounded text, fetched one after another."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    ids, texts, size, none = [], [], 0, True
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= block_bytes:
            yield compile_items(ids, texts)
            ids, texts, size, none = [], [], 0, False
    if ids or none:
        yield compile_items(ids, texts)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Words of each document (doc_id, text) inside an occurrence of an item's window.

    Each document is winnowed where it lies: of any ``WINDOW`` consecutive words the
    k-gram of least hash is kept. Kept k-grams that an item has too are extended to all
    windows around them, and those are compared word by word. So every shared run of
    ``WINDOW`` words is found, and no document leaves its task. Items are sent to the
    tasks in blocks of at most ``block_bytes`` of text; each block takes a pass over
    the documents, and passes are joined per document by an aggregation.

    Null and empty texts have no words and no hits. Items without id or text are left
    out; items that share an id count as one. Shorter items match as a whole. A null
    doc_id is carried through, repeated rows each get their result, and other columns
    are ignored. Without items nothing is hit. ``contaminated`` is ``n_hit > 0``.
    """
    blocks = item_blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _pass(docs, block)[0].drop("row_key", "hit", "item_ids")
    # Each pass is written, so that one block at a time is held. Passes meet by document
    # and text, as ids may be null or repeated.
    passes = []
    while block is not None:
        rows, sent = _pass(docs, block)
        passes.append(stored(rows))
        sent.destroy()
        block, following = following, next(blocks, None)
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    keyed = every.groupBy("doc_id", "row_key").agg(
        (F.count("*") / F.lit(len(passes))).cast("int").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.collect_set("hit").alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"),
    )
    return keyed.mapInArrow(_merge, _RESULT)


def without_hits(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` in which no word is hit, found as in :func:`decontaminate`.

    Rows are dropped where they lie. Further blocks of items take further passes, over
    what the pass before has left.
    """
    blocks = item_blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    while following is not None:
        rows, sent = _clean_pass(docs, block)
        docs = stored(rows)
        sent.destroy()
        block, following = following, next(blocks, None)
    return _clean_pass(docs, block)[0]


def _clean_pass(docs: DataFrame, compiled: dict[int, Items]) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(compiled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            first, _, hit, _ = find_hits(batch.column("text"), sent.value)
            total = np.concatenate([[0], np.cumsum(hit)])
            yield batch.filter(pa.array(total[first[1:]] == total[first[:-1]]))

    return docs.mapInArrow(run, docs.schema), sent


_RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
    "contaminated boolean"
)


def digest_of_items(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            hit = np.zeros(row["n_words"], bool)
            for bits in row["hits"]:
                hit |= np.unpackbits(np.frombuffer(bits, np.uint8))[: len(hit)].astype(bool)
            items, n = set(row["item_ids"]), int(hit.sum())
            one = (row["doc_id"], row["n_words"], n, len(items), digest_of_items(items), n > 0)
            rows += [one] * row["copies"]
        yield _result_batch(rows)


def _result_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in _RESULT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def _pass(docs: DataFrame, compiled: dict[int, Items]) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(compiled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            first, _, hit, found = find_hits(batch.column("text"), sent.value)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[first[1:]] - total[first[:-1]]
            n_words = np.diff(first)
            bits = [
                np.packbits(hit[a:b]).tobytes()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_key"),
                    batch.column("doc_id"),
                    pa.array(n_words),
                    pa.array(n_hit),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([digest_of_items(x) for x in found], pa.string()),
                    pa.array(n_hit > 0),
                    pa.array(bits, pa.binary()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.int64())),
                ],
                names=[
                    "row_key", "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                    "contaminated", "hit", "item_ids",
                ],
            )

    keyed = docs.select(F.xxhash64("text").alias("row_key"), "doc_id", "text")
    rows = keyed.mapInArrow(run, f"row_key long, {_RESULT}, hit binary, item_ids array<long>")
    return rows, sent
