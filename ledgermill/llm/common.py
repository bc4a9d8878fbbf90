"""Shared helpers: text as byte arrays, word positions, hashes, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Bytes of text handled at once in a task; a longer text is handled alone.
SLICE_BYTES = 1024 * 1024

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# True for bytes of words that white space ends.
SPACED_WORD = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
# True for bytes of words of ASCII letters and digits and all other scripts, once in lower case.
LETTER_WORD = _ALNUM
# Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM_CODE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(values: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit values, so that every bit depends on all others."""
    values = values ^ (values >> _SHIFT)
    values *= _MIX_A
    values ^= values >> _SHIFT
    values *= _MIX_B
    values ^= values >> _SHIFT
    return values


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one more entry at the end)."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, starts, data = column.buffers()
    offsets = np.zeros(1, np.int64)
    if len(column):
        offsets = np.frombuffer(starts, wide)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, done + limit, side="right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def words_of(
    data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the first word of each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = in_word[data]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between calls up to the usual slice."""
    have = _powers.get("base")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            tables.append(table)
        if size > 2 * SLICE_BYTES:
            return tables[0], tables[1]
        _powers["base"], _powers["inverse"] = tables
    return _powers["base"], _powers["inverse"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base, inverse = _power_table(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.multiply(_BYTE_CODE[data], base[: len(data)], out=total[1:])
    np.add.accumulate(total, out=total)
    hashes = total[ends] - total[starts]
    hashes *= inverse[starts]
    hashes += (ends - starts).astype(np.uint64)
    return mix(hashes)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive hashes; the caller drops runs over two texts."""
    count = max(0, len(hashes) - n + 1)
    grams = np.zeros(count, np.uint64)
    for k in range(n):
        # A code of its own for each place, also beyond the table.
        code = _GRAM_CODE[k % 64] * np.uint64(2 * (k // 64) + 1)
        grams += hashes[k : k + count] * code
    return mix(grams)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z as a-z, and the number of the first word of each text.

    Works through blocks that end outside of words, so that beside one block (or one longer
    word) it holds two numbers a word, however long a text is.
    """
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at, length = 0, SLICE_BYTES
    while at < len(data):
        end = min(at + length, len(data))
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "right")]
        if end < len(data):
            outside = np.flatnonzero(~in_word[data[at:end]])
            cut = max(at + int(outside[-1]) + 1 if len(outside) else at, int(inner[-1]) if len(inner) else at)
            if cut == at:
                length *= 2
                continue
            end, length = cut, SLICE_BYTES
        block = LOWER[data[at:end]]
        heads = np.concatenate([[0], inner[inner < end] - at, [end - at]])
        starts, ends, _ = words_of(block, heads, in_word)
        hashes.append(span_hashes(block, starts, ends))
        begins.append(starts + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def strings(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.string())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once per application.

    Spark serves the archive from the driver, so executors need no copy installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ledgermill-")) / "ledgermill_modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    A local session without that setting uses its warehouse folder, as its only
    machine reads it. Elsewhere the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, survives lost executors."""
    return stored_at(df, shared_folder(df.sparkSession))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """As ``stored``, at a path of the shared folder and in place of what was there."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if not spark.sparkContext.master.startswith("local["):
        # Shuffle files go once the driver has collected what refers to them.
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
