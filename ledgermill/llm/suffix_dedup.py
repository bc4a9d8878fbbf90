"""Suffix-array dedup: Burrows-Wheeler transforms merged by iterative interleave refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermill.llm import common
from ledgermill.llm.common import expand, mix, slices, span_hashes, stored, text_buffers

LENGTH = 200
# Bytes of the grams that meet in a bucket; a repeat holds one of LENGTH - GRAM + 1.
GRAM = 64
# Contexts merged at once in a task. Buckets of more contexts than HOT are spread instead.
MERGED, HOT = 4096, 100_000

_FOUND = "doc_id long, text_key long, at int, shape int, gram long, context long"
_RANGES = "gram long, context long, low int, high int"


def pick_grams(
    data: np.ndarray, offsets: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that have the least hash in a string of ``length`` bytes.

    The choice rests on the string alone (the first of equal hashes counts), so equal
    strings hold a chosen gram at the same place, wherever they stand.
    """
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    if not counts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base, inverse = common._power_table(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.multiply(common._BYTE_CODE[data], base[: len(data)], out=total[1:])
    np.add.accumulate(total, out=total)
    hashes = total[gram:] - total[:-gram]
    hashes *= inverse[: len(hashes)]
    hashes = mix(hashes)
    least, at, size = hashes, np.arange(len(hashes), dtype=np.int64), 1
    wide = length - gram + 1
    while size < wide:
        step = min(size, wide - size)
        left, right = least[:-step], least[step:]
        at = np.where(right < left, at[step:], at[:-step])
        least = np.minimum(left, right)
        size += step
    chosen = np.zeros(len(hashes), bool)
    chosen[at[expand(offsets[:-1], counts)]] = True
    places = np.flatnonzero(chosen)
    return places, hashes[places]


def merge_contexts(rows: list[bytes], leads: list[int], length: int, gram: int) -> np.ndarray:
    """Which strings of ``length`` bytes around the common gram stand in two rows or more.

    ``rows`` are the texts around occurrences of one or more grams, ``leads`` the bytes before
    the gram in each. Every row is a shard with a transform of its own, its bytes read from
    the end: as the rows stand aligned at their grams, symbol c of a row's transform leads
    from its suffix at c + 1 to that at c. The transforms are merged by refining the
    interleave of the rows' suffixes: the order for c is that for c + 1, stably dealt by
    the symbol at c. Suffixes are never sorted anew. Common prefixes of neighbours follow
    along: those of two rows that become neighbours are one longer than the least
    between them before. Neighbours that share ``length`` bytes form a repeated interval.

    Returned is a table of rows x starts; start s is s bytes after ``length - gram`` bytes
    before the gram.
    """
    before, m = length - gram, len(rows)
    width = before + length
    symbols = np.full((width, m), 256, np.uint16)
    firsts = before - np.asarray(leads, np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, m)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    owner = np.repeat(np.arange(m), sizes)
    symbols[expand(firsts, sizes), owner] = flat
    order, common_to_last = np.arange(m), np.zeros(m, np.int16)
    repeated = np.zeros((m, before + 1), bool)
    levels = max(1, int(m).bit_length())
    least = np.zeros((levels, m), np.int16)
    log = np.zeros(m + 1, np.int64)
    log[1:] = np.floor(np.log2(np.arange(1, m + 1) + 0.5)).astype(np.int64)
    for c in range(width - 1, -1, -1):
        symbol = symbols[c][order]
        dealt = np.argsort(symbol, kind="stable")
        # Least common prefix over every power of two of neighbours.
        least[0] = common_to_last
        for k in range(1, levels):
            half = 1 << (k - 1)
            least[k, : m - half] = np.minimum(least[k - 1, : m - half], least[k - 1, half:])
            least[k, m - half :] = least[k - 1, m - half :]
        low, high = dealt[:-1] + 1, dealt[1:]
        same = symbol[dealt[:-1]] == symbol[dealt[1:]]
        low, high = low[same], high[same]
        power = log[high - low + 1]
        shared = np.minimum(least[power, low], least[power, high - (1 << power) + 1])
        common_to_last = np.zeros(m, np.int16)
        common_to_last[1:][same] = shared + 1
        order = order[dealt]
        if c <= before:
            long = common_to_last >= length
            long[:-1] |= common_to_last[1:] >= length
            whole = (firsts[order] <= c) & (c + length <= firsts[order] + sizes[order])
            repeated[order[long & whole], c] = True
    return repeated


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


class SuffixDedup:
    """Finds and removes every byte covered by a repeated string of ``length`` bytes.

    1. Of each string of ``length`` bytes the gram of least hash is chosen, so equal strings
       meet at equal grams. Grams found once are dropped; texts stay where they are.
    2. The text around a gram, its context, holds all strings that chose it. Contexts are
       counted by a hash of 128 bits with the gram's. Equal ones are merged before the
       shuffle and fetched once; a context found twice is a repeat as a whole.
    3. Buckets with several contexts are merged by :func:`merge_contexts`. A bucket of
       more than ``HOT`` contexts is spread: its strings are counted by hash all over.
    4. Repeats go back to the occurrences of their contexts and to the texts.

    Strings are judged on the input. A null text counts as empty. Rows are told apart by
    doc_id and text together: ids may be null or repeated, and repeated rows of enough bytes
    are repeats of each other. Texts shorter than ``length`` are never cut.
    """

    def __init__(self, length: int = LENGTH, gram: int | None = None):
        self.length = length
        self.gram = min(GRAM, length // 2) if gram is None else gram

    def remove(self, docs: DataFrame, as_text: bool = False) -> DataFrame:
        """``docs`` (doc_id, text, more) with ``kept_bytes``, ``n_bytes``, ``n_removed`` and
        ``n_spans``; columns of these names are replaced. With ``as_text`` there is
        ``kept_text`` in place of the bytes, without the rests of characters cut through."""
        kept_as = "kept_text" if as_text else "kept_bytes"
        new = (kept_as, "n_bytes", "n_removed", "n_spans", "removed_ranges")
        fields = [f for f in docs.schema.fields if f.name not in new]
        spans = self.spans(docs)
        keyed = docs.select(
            *[f"`{f.name}`" for f in fields], F.xxhash64("text").alias("removed_ranges")
        )
        same = keyed["doc_id"].eqNullSafe(spans["span_doc"]) & (
            keyed["removed_ranges"] == spans["span_key"]
        )
        joined = keyed.join(spans, same, "left").select(
            *[keyed[f"`{f.name}`"] for f in fields], "ranges"
        )
        counts = ", ".join(f"{n} long" for n in new[1:4])
        schema = StructType([*fields, *StructType.fromDDL(f"{kept_as} {'string' if as_text else 'binary'}, {counts}")])
        names = schema.fieldNames()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                rows = [
                    _cut(text.as_buffer().to_pybytes() if text.is_valid else b"", ranges)
                    for text, ranges in zip(
                        batch.column("text"), batch.column("ranges").to_pylist(), strict=True
                    )
                ]
                kept, *numbers = zip(*rows, strict=True)
                if as_text:
                    kept = [data.decode("utf-8", "ignore") for data in kept]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in fields]
                    + [pa.array(kept, pa.string() if as_text else pa.binary())]
                    + [pa.array(x, pa.int64()) for x in numbers],
                    names=names,
                )

        return joined.mapInArrow(run, schema)

    def spans(self, docs: DataFrame) -> DataFrame:
        """Byte ranges that repeats cover, by (span_doc, span_key): ``ranges``, not merged yet."""
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        found = texts.mapInArrow(self._find(), _FOUND)
        twice = found.groupBy("gram").count().where("count > 1").select("gram")
        # Written first, so that a gram with a third of all places can be split in the join.
        twice = stored(twice)
        found = stored(found.join(twice, "gram").select(*_names(_FOUND)))

        first = F.min(F.struct("doc_id", "text_key", "at", "shape")).alias("first")
        contexts = stored(
            found.groupBy("gram", "context").agg(first, F.count("*").alias("copies"))
        )
        buckets = contexts.groupBy("gram").agg(
            F.count("*").alias("members"), F.min("copies").alias("fewest")
        )
        # Where every context is found twice nothing is left to compare.
        buckets = stored(buckets.where("members > 1 and fewest = 1").select("gram", "members"))
        repeats = contexts.where("copies > 1").select(
            "gram", "context", (-_lead("first.shape")).alias("low"),
            (_size("first.shape") - _lead("first.shape")).alias("high"),
        )

        asked = contexts.join(buckets, "gram").select(
            F.col("first.doc_id").alias("ask_doc"), F.col("first.text_key").alias("ask_key"),
            F.struct(
                "gram", "context", F.col("first.at").alias("at"), F.col("first.shape").alias("shape"),
                (F.col("members") > HOT).alias("hot"),
            ).alias("one"),
        )
        asked = asked.groupBy("ask_doc", "ask_key").agg(F.collect_list("one").alias("asked"))
        same = texts["doc_id"].eqNullSafe(asked["ask_doc"]) & (
            texts["text_key"] == asked["ask_key"]
        )
        fetched = texts.join(asked, same).select("text", "asked")
        around = fetched.mapInArrow(
            _fetch, "gram long, context long, lead int, hot boolean, around binary"
        )
        around = stored(around)
        merged = (
            around.where("not hot")
            .drop("hot")
            .repartition("gram")
            .sortWithinPartitions("gram")
            .mapInArrow(self._merge(), _RANGES)
        )
        every = repeats.unionByName(merged).unionByName(self._spread(around.where("hot")))

        covered = found.join(every, ["gram", "context"]).select(
            F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"),
            F.struct((F.col("at") + F.col("low")).alias("from"), (F.col("at") + F.col("high")).alias("to")).alias("range"),
        )
        return stored(
            covered.groupBy("span_doc", "span_key").agg(F.collect_set("range").alias("ranges"))
        )

    def _find(self):
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                data, offsets = text_buffers(batch.column("text"))
                places, hashes = pick_grams(data, offsets, length, gram)
                row = np.searchsorted(offsets, places, side="right") - 1
                begin = np.maximum(places - (length - gram), offsets[row])
                end = np.minimum(places + length, offsets[row + 1])
                lead, size = places - begin, end - begin
                context = span_hashes(data, begin, end) ^ mix(lead.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        batch.column("text_key").take(pa.array(row)),
                        pa.array((places - offsets[row]).astype(np.int32)),
                        pa.array((lead << 16 | size).astype(np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(context.view(np.int64)),
                    ],
                    names=_names(_FOUND),
                )

        return run

    def _merge(self):
        length, gram = self.length, self.gram

        def merged(rows: dict) -> pa.RecordBatch:
            keys = list(rows)
            table = merge_contexts(
                [rows[k][1] for k in keys], [rows[k][0] for k in keys], length, gram
            )
            out = [
                (*keys[r], first - (length - gram), last - 1 - (length - gram) + length)
                for r in np.flatnonzero(table.any(axis=1)).tolist()
                for first, last in _runs(table[r])
            ]
            return _ranges(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, last = {}, None
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(4)]
                for g, context, lead, around in zip(*columns, strict=True):
                    # Buckets stay whole.
                    if g != last and len(rows) >= MERGED:
                        yield merged(rows)
                        rows = {}
                    rows[g, context] = lead, around
                    last = g
            if rows:
                yield merged(rows)

        return run

    def _spread(self, hot: DataFrame) -> DataFrame:
        """Ranges of repeated strings in hot buckets, each string counted by its hash."""
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4)]
                for g, context, lead, around in zip(*columns, strict=True):
                    data = np.frombuffer(around, np.uint8)
                    starts = np.arange(min(lead, len(data) - length) + 1)
                    starts = starts[lead - starts <= length - gram]
                    keys = span_hashes(data, starts, starts + length).view(np.int64)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([g] * n, pa.int64()),
                            pa.array([context] * n, pa.int64()),
                            pa.array((starts - lead).astype(np.int32)),
                            pa.array((starts - lead + length).astype(np.int32)),
                            pa.array(keys),
                        ],
                        names=[*_names(_RANGES), "string"],
                    )

        strings = hot.mapInArrow(run, f"{_RANGES}, string long")
        keys = ["gram", "string", "low"]
        twice = strings.groupBy(*keys).count().where("count > 1").select(*keys)
        return strings.join(twice, keys).select(*_names(_RANGES))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _lead(shape: str):
    return F.shiftright(F.col(shape), 16)


def _size(shape: str):
    return F.col(shape).bitwiseAND(0xFFFF)


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_names(_RANGES)
    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts around the places asked for."""
    for batch in slices(batches, "text"):
        rows = []
        for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            data = text.as_buffer()
            for one in asked:
                lead, size = one["shape"] >> 16, one["shape"] & 0xFFFF
                begin = one["at"] - lead
                around = data.slice(begin, size).to_pybytes()
                rows.append((one["gram"], one["context"], lead, one["hot"], around))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["gram", "context", "lead", "hot", "around"],
        )


def _cut(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int, int]:
    """The bytes left, how many there were, how many are gone, and in how many runs."""
    kept, at, runs = [], 0, 0
    reach = -1
    for begin, end in sorted((r["from"], r["to"]) for r in ranges or ()):
        if begin > reach:
            runs += 1
            kept.append(data[at:begin])
        reach = max(reach, end)
        at = reach
    kept.append(data[at:])
    left = b"".join(kept)
    return left, len(data), len(data) - len(left), runs


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes", "n_removed", "n_spans",
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
