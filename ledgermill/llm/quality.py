"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgermill.llm.common import (
    SPACED_WORD,
    expand,
    gram_hashes,
    slices,
    span_hashes,
    text_buffers,
    words_of,
)

# Largest share of a text's word characters inside n-grams seen before, by length, as
# published for web corpora (fixed values).
REPEAT_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# Largest share of lines, and of characters inside lines, seen before (fixed values).
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
MIN_WORDS, MAX_REPEAT_WORDS_PERCENT, BASE_GRAM = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, "
    "repeat_chars array<long>"
)


def score_repetition(docs: DataFrame, shares: dict[int, float] | None = None) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text), row by row, no shuffle.

    ``repeat_chars`` holds, for each n-gram length in ``shares``, the characters inside
    n-grams that stand earlier in the text; ``dup_line_chars`` those inside repeated
    lines. ``kept`` is false where a share is above its limit or a base rule fails.

    Null and empty texts have no words, all counts 0, and fail the base rule. A null
    doc_id is carried through, and repeated rows each get their own result. Columns
    other than doc_id and text are ignored. A very long text is handled alone.
    """
    shares = dict(REPEAT_SHARES if shares is None else shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _score(batch, shares)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the entries of ``first``."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _seen(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: stands an equal key earlier in its group; is its key there twice or more."""
    order = np.lexsort((keys, groups))
    if not len(order):
        return np.zeros(0, bool), np.zeros(0, bool)
    same = (keys[order][1:] == keys[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a run of ``n`` words that begins at one of ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change)[:-1] > 0


def _windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-word windows inside a text, and the text of each."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return expand(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def _score(batch: pa.RecordBatch, shares: dict[int, float]) -> pa.RecordBatch:
    data, offsets = text_buffers(batch.column("text"))
    starts, ends, first = words_of(data, offsets, SPACED_WORD)
    n_words = np.diff(first)
    hashes = span_hashes(data, starts, ends)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    word_chars = _per_text(chars, first)

    symbol = np.concatenate([np.zeros(1, np.int64), np.cumsum(_SYMBOL[data])])
    n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    text_of_line = np.searchsorted(offsets, line_starts, side="right") - 1
    next_break = np.searchsorted(breaks, line_starts)
    line_ends = offsets[text_of_line + 1].copy()
    has = next_break < len(breaks)
    line_ends[has] = np.minimum(line_ends[has], breaks[next_break[has]])
    word_at = np.searchsorted(starts, line_starts)
    with_word = word_at < np.searchsorted(starts, line_ends)
    line_starts, line_ends, text_of_line = (
        x[with_word] for x in (line_starts, line_ends, text_of_line)
    )
    repeated, _ = _seen(span_hashes(data, line_starts, line_ends), text_of_line)
    texts = len(offsets) - 1
    n_lines = np.bincount(text_of_line, minlength=texts)
    n_dup_lines = np.bincount(text_of_line[repeated], minlength=texts)
    in_dup = np.zeros(len(starts) + 1, np.int64)
    np.add.at(in_dup, np.searchsorted(starts, line_starts[repeated]), 1)
    np.add.at(in_dup, np.searchsorted(starts, line_ends[repeated]), -1)
    dup_line_chars = _per_text(chars * (np.cumsum(in_dup)[:-1] > 0), first)

    grams, owner = _windows(first, BASE_GRAM)
    _, twice = _seen(gram_hashes(hashes, BASE_GRAM)[grams], owner)
    n_repeat = _per_text(_covered(grams[twice], BASE_GRAM, len(starts)), first)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_WORDS_PERCENT * n_words)

    ok = n_dup_lines <= LINE_SHARE * n_lines
    ok &= dup_line_chars <= LINE_CHAR_SHARE * word_chars
    covered = []
    for n, share in shares.items():
        grams, owner = _windows(first, n)
        later, _ = _seen(gram_hashes(hashes, n)[grams], owner)
        inside = _per_text(chars * _covered(grams[later], n, len(starts)), first)
        ok &= inside <= share * word_chars
        covered.append(inside)
    per_row = np.stack(covered, axis=1).ravel() if covered else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            *(
                pa.array(x.astype(np.int64))
                for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
            ),
            pa.array(failed),
            pa.array(ok & ~failed),
            pa.array(dup_line_chars),
            pa.ListArray.from_arrays(
                pa.array(np.arange(texts + 1, dtype=np.int32) * len(covered)), pa.array(per_row)
            ),
        ],
        names=[
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "dup_line_chars", "repeat_chars",
        ],
    )
