"""Near-duplicate documents by an exact n-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import (
    LOWER,
    SPACED_WORD,
    gram_hashes,
    mix,
    slices,
    span_hashes,
    stored,
    text_buffers,
    words_of,
)
from ledgermill.llm.components import smallest_reachable

SHINGLE_WORDS = 5
PERCENT = 80
# Counters of the frequency table by which shingles are ordered; 4 bytes each.
COUNTERS = 1 << 18
# Longest extra prefix, and the cost of checking a pair against that of reading a posting.
MOST_MATCHES, CHECK_COST = 32, 1.0
# Documents to fetch again whose ids are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
# Tables of counters added up by one task.
MERGED_TABLES = 32


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_buffers(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, SPACED_WORD)
    hashes = span_hashes(data, starts, ends)
    grams = gram_hashes(hashes, SHINGLE_WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < SHINGLE_WORDS:
            yield gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            continue
        keys = np.sort(grams[a : b - SHINGLE_WORDS + 1])
        distinct = np.empty(len(keys), bool)
        distinct[0] = True
        np.not_equal(keys[1:], keys[:-1], out=distinct[1:])
        yield keys[distinct]


def _signature(keys: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    one = np.add.reduce(mix(keys), dtype=np.uint64)
    two = np.add.reduce(mix(~keys), dtype=np.uint64)
    return int(np.int64(one)), int(np.int64(two))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the size and signature of its set; last, a table of counts of this task."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in slices(batches, "text"):
        rows, keys_of_all = [], []
        for keys in shingle_sets(batch.column("text")):
            rows.append((len(keys), *_signature(keys)))
            keys_of_all.append(keys)
        counts += np.bincount(_bucket(np.concatenate(keys_of_all)), minlength=COUNTERS)
        n, s1, s2 = zip(*rows, strict=True)
        yield _described(batch.column("doc_id"), n, s1, s2, [None] * len(n))
    if counts.any():
        yield _described(pa.nulls(1, pa.int64()), [0], [0], [0], [counts.tobytes()])


def _described(doc_id: pa.Array, n, s1, s2, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, *(pa.array(x, pa.int64()) for x in (n, s1, s2)), pa.array(counts, pa.binary())],
        names=["doc_id", "n_shingles", "s1", "s2", "counts"],
    )


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def _frequencies(described: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each counter: the tasks' tables, added up in a tree."""
    tables = described.where("counts is not null").select("counts")
    left = tables.count()
    while left > 1:
        left = -(-left // MERGED_TABLES)
        tables = stored(tables.repartition(left).mapInArrow(_add_counts, "counts binary"))
    rows = tables.collect()
    return np.frombuffer(bytes(rows[0][0]), np.int64) if rows else np.zeros(COUNTERS, np.int64)


def choose_matches(frequency: np.ndarray, n: int, percent: int = PERCENT) -> int:
    """How many shared prefix shingles to ask of a set, whose frequencies come rarest first.

    Asking for ``m`` lengthens the prefix by ``m - 1``. A partner then stands in ``m`` of
    the prefix's posting lists, so there are at most their total length over ``m``. The
    cheapest sum of postings read and pairs checked wins; rare shingles win with 1.
    """
    need = -(-percent * n // 100)
    most = min(MOST_MATCHES, need)
    others = np.cumsum(frequency - 1)
    m = np.arange(1, most + 1)
    read = others[n - need + m - 1]
    cost = read + m + CHECK_COST * read / m
    return int(np.argmin(cost)) + 1


def _prefixes(frequencies: np.ndarray):
    """Task function: the prefix of each set in the global order, rarest shingles first."""
    usual = int(np.median(frequencies))
    noise = usual + 3 * int(np.sqrt(usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s1, s2, n, matches, prefixes = [], [], [], [], []
            for keys in shingle_sets(batch.column("text")):
                a, b = _signature(keys)
                s1.append(a)
                s2.append(b)
                n.append(len(keys))
                if not len(keys):
                    matches.append(0)
                    prefixes.append(keys.view(np.int64))
                    continue
                counted = frequencies[_bucket(keys)]
                order = np.lexsort((keys, counted))
                m = choose_matches(np.maximum(counted[order] - noise, 1), len(keys))
                matches.append(m)
                size = len(keys) - -(-PERCENT * len(keys) // 100) + m
                prefixes.append(keys[order[:size]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in (s1, s2, n, matches)),
                    _lists(prefixes),
                ],
                names=["doc_id", "s1", "s2", "n", "matches", "prefix"],
            )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = _lists(list(shingle_sets(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["id", "shingles"])


# What a posting says of its set, in one number: size, matches asked for, place in the order.
def _packed(n: Column, matches: Column, place: Column) -> Column:
    return F.shiftleft(n, 36) + F.shiftleft(matches, 28) + place


def _size(packed: str) -> Column:
    return F.shiftright(packed, 36)


def _matches(packed: str) -> Column:
    return F.shiftright(packed, 28).bitwiseAND(255)


def _place(packed: str) -> Column:
    return F.col(packed).bitwiseAND((1 << 28) - 1)


def _needed(n_x: Column, n_y: Column) -> Column:
    """Least number of shared shingles that makes two sets of these sizes similar."""
    up = F.lit(99 + PERCENT)
    return F.call_function("div", PERCENT * (n_x + n_y) + up, F.lit(100 + PERCENT))


def _can_meet() -> Column:
    """Is this meeting within the prefixes that the two sizes call for?

    Sets that share ``needed`` shingles share ``m`` of the first ``n - needed + m`` of each.
    These prefixes are no longer than those sent, which hold for partners of any size.
    """
    x, y = _size("x_about"), _size("y_about")
    extra = F.least(_matches("x_about"), _matches("y_about")) - _needed(x, y)
    similar_size = 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)
    return similar_size & (_place("x_about") < x + extra) & (_place("y_about") < y + extra)


def _can_meet_from(least: str) -> Column:
    """Is the posting within the prefix called for by any partner of ``least`` shingles or more?"""
    x = _size("x_about")
    partner = F.greatest(F.col(least), F.call_function("div", PERCENT * x + 99, F.lit(100)))
    return _place("x_about") < x + _matches("x_about") - _needed(x, partner)


def _candidates(meetings: DataFrame) -> DataFrame:
    """Pairs (x, y) that share enough prefix shingles, of rows (x, x_about, y, y_about)."""
    met = (
        meetings.where(_can_meet())
        .select(
            "x", "y",
            _size("x_about").alias("n_x"), _size("y_about").alias("n_y"),
            F.least(_matches("x_about"), _matches("y_about")).alias("asked"),
            _place("x_about").alias("at_x"), _place("y_about").alias("at_y"),
        )
        .groupBy("x", "y", "n_x", "n_y", "asked")
        .agg(F.count("*").alias("shared"), F.max("at_x").alias("at_x"), F.max("at_y").alias("at_y"))
    )
    # All shared shingles up to the last meeting are counted; the rest come after it.
    most = F.col("shared") + F.least(F.expr("n_x - 1 - at_x"), F.expr("n_y - 1 - at_y"))
    enough = most >= _needed(F.col("n_x"), F.col("n_y"))
    return met.where((F.col("shared") >= F.col("asked")) & enough).select("x", "y").distinct()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    pairs = stored(pairs)
    ids = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
    ids = stored(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(_sets, "id long, shingles array<long>"))
    left = sets.select(F.col("id").alias("x"), F.col("shingles").alias("of_x"))
    right = sets.select(F.col("id").alias("y"), F.col("shingles").alias("of_y"))
    both = F.size(F.array_intersect("of_x", "of_y"))
    whole = F.size("of_x") + F.size("of_y") - both
    return (
        pairs.join(left, "x").join(right, "y").where(100 * both >= PERCENT * whole).select("x", "y")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Size of each document's shingle set and the least doc_id it is linked to by a chain.

    Sets of five-word shingles link when their Jaccard similarity is at least 0.8.
    Equal sets are one class, merged before any shuffle of shingles. Each class sends the
    rarest shingles of its set (by a table of counts over all documents, of fixed size)
    as prefix postings. The prefix is as long as the estimated cost of its candidates
    suggests: a prefix longer by m - 1 asks for m shared prefix shingles, and a pair must
    share the smaller number of the two. No pair is lost by that.

    Pairs are checked in two steps, so that a large group of near copies is not paired
    up: first every class with the head of each posting list, then, on lists
    that still hold several components, classes of different components. Pairs inside a
    component change nothing and are left out, so each link between components counts.

    Null, empty and white-space texts have no shingles and link with nothing. Rows with a
    null doc_id are returned, and belong to the component of equal texts if there is one,
    else to null. Repeated rows are each returned; texts that share a doc_id link what
    either links. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", "text")
    described = stored(
        texts.mapInArrow(
            _describe, "doc_id long, n_shingles long, s1 long, s2 long, counts binary"
        )
    )
    prefixes = texts.mapInArrow(
        _prefixes(_frequencies(described)),
        "doc_id long, s1 long, s2 long, n long, matches long, prefix array<long>",
    )
    classes = (
        prefixes.where("n > 0 and doc_id is not null")
        .groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("x"), F.first(F.struct("n", "matches", "prefix")).alias("of"))
    )
    # What is joined is written first, so that hot keys of the other side can be split.
    classes = stored(classes)
    postings = classes.select("x", "of", F.posexplode("of.prefix").alias("place", "shingle"))
    postings = postings.select(
        "shingle", "x", _packed(F.col("of.n"), F.col("of.matches"), F.col("place").cast("long")).alias("x_about")
    )
    # A text that others were made from has few rarer shingles before the shared ones.
    heads = postings.groupBy("shingle").agg(
        F.min(F.struct(_place("x_about").alias("at"), "x", "x_about")).alias("head"),
        F.count("*").alias("length"),
    )
    heads = heads.where("length > 1").select("shingle", "head.x", "head.x_about")
    heads = stored(heads.toDF("shingle", "y", "y_about"))
    lists = stored(postings.join(heads, "shingle"))

    links = stored(_verified(docs, _candidates(lists.where("x <> y"))))
    joined = smallest_reachable(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    placed = lists.select("shingle", "x", "x_about").join(
        joined.withColumnRenamed("node", "x"), "x", "left"
    )
    placed = stored(
        placed.select("shingle", "x", "x_about", F.coalesce("root", "x").alias("in_x"))
    )
    mixed = placed.groupBy("shingle").agg(
        F.min("in_x").alias("low"), F.max("in_x").alias("high"), F.min(_size("x_about")).alias("least")
    )
    mixed = stored(mixed.where("low < high").select("shingle", "least"))
    mixed = placed.join(mixed, "shingle")
    mixed = mixed.where(_can_meet_from("least")).drop("least")
    other = mixed.toDF("shingle", "y", "y_about", "in_y")
    across = mixed.join(other, "shingle").where("x < y and in_x <> in_y")
    more = stored(_verified(docs, _candidates(across)))

    every = links.union(more).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = smallest_reachable(every)
    rows = described.where("counts is null").drop("counts")
    members = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    members = members.join(roots, "node", "left").select(
        "s1", "s2", F.coalesce("root", "node").alias("found")
    )
    return rows.join(stored(members), ["s1", "s2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id")).alias(
            "component_id"
        ),
    )
