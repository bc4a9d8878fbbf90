"""Near-duplicate documents by circulant MinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import (
    SPACED_WORD,
    gram_hashes,
    mix,
    slices,
    stored,
    text_buffers,
    word_hashes,
)
from ledgermill.llm.components import smallest_reachable

SHINGLE_WORDS = 4
PERCENT = 80
# Shingles are hashed to 2^UNIVERSE_BITS places, which both permutations act on.
UNIVERSE_BITS = 22
# Two sets meet where all ROWS coordinates of one of BANDS bands agree. A pair of similarity
# 0.8 meets nowhere with probability (1 - 0.8^5)^40, about 1 in 7 million.
BANDS, ROWS = 40, 5
# Members of mixed buckets of more classes are paired by their rarest shingles.
CROWD = 8
# Documents to fetch again whose ids are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
# Shingles, and rows of the shifted permutation, handled at once.
SHINGLE_BLOCK, ROW_BLOCK = 1 << 17, 2048

DESCRIBED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


class Circulant:
    """All coordinates of a MinHash signature from two permutations.

    The first permutation sends a shingle to a place. Coordinate k of a set is the least
    value of the second permutation, shifted by k places, over the places of its shingles.
    With the second one laid out on a ring, the coordinates of one shingle are a run of
    neighbours, so a signature is the column-wise minimum of such runs.
    """

    def __init__(self, bits: int = UNIVERSE_BITS, width: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        ring = np.arange(1 << bits, dtype=np.uint32)
        self.shift = np.uint64(64 - bits)
        self.first = rng.permutation(ring)
        second = rng.permutation(ring)
        second = np.concatenate([second, second[: width - 1]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(second, width)

    def signature(self, keys: np.ndarray) -> np.ndarray:
        """The coordinates of a set of 64-bit hashes, of which there is at least one."""
        places = self.first[keys >> self.shift]
        least = self.shifted[places[:ROW_BLOCK]].min(axis=0)
        for at in range(ROW_BLOCK, len(places), ROW_BLOCK):
            block = self.shifted[places[at : at + ROW_BLOCK]].min(axis=0)
            np.minimum(least, block, out=least)
        return least


_circulant: list[Circulant] = []
_BAND_CODE = np.random.default_rng(12).integers(1, 2**62, (BANDS, ROWS + 1), dtype=np.uint64)


def _bands(keys: np.ndarray) -> np.ndarray:
    """One hash per band of the set's signature, different bands never meant to meet."""
    if not _circulant:
        _circulant.append(Circulant())
    rows = _circulant[0].signature(keys).astype(np.uint64).reshape(BANDS, ROWS)
    code = _BAND_CODE[:, :ROWS] * np.uint64(2) + np.uint64(1)
    return mix((mix(rows + _BAND_CODE[:, ROWS:]) * code).sum(axis=1, dtype=np.uint64)).view(np.int64)


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``n`` words."""
    data, offsets = text_buffers(column)
    hashes, first = word_hashes(data, offsets, SPACED_WORD)
    grams = np.empty(max(0, len(hashes) - n + 1), np.uint64)
    for at in range(0, len(grams), SHINGLE_BLOCK):
        part = gram_hashes(hashes[at : at + SHINGLE_BLOCK + n - 1], n)
        grams[at : at + len(part)] = part
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < n:
            yield gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            continue
        keys = grams[a : b - n + 1]
        keys.sort()
        distinct = np.empty(len(keys), bool)
        distinct[0] = True
        np.not_equal(keys[1:], keys[:-1], out=distinct[1:])
        yield keys[distinct]


def _set_id(keys: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    one = two = np.uint64(0)
    for at in range(0, len(keys), SHINGLE_BLOCK):
        part = keys[at : at + SHINGLE_BLOCK]
        one += np.add.reduce(mix(part), dtype=np.uint64)
        two += np.add.reduce(mix(~part), dtype=np.uint64)
    return int(np.int64(one)), int(np.int64(two))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows, bands, ends = [], [np.zeros(0, np.int64)], [0]
        for keys in shingle_sets(batch.column("text")):
            rows.append((len(keys), *_set_id(keys)))
            bands.append(_bands(keys) if len(keys) else np.zeros(0, np.int64))
            ends.append(ends[-1] + len(bands[-1]))
        lists = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate(bands))
        )
        numbers = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *numbers, lists],
            names=["doc_id", "n_shingles", "s1", "s2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = list(shingle_sets(batch.column("text")))
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))
        )
        ids = zip(*map(_set_id, sets), strict=True)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in ids), lists], names=["s1", "s2", "shingles"]
        )


def _similar_size(a: str, b: str):
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _sets_of(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole shingle sets (row, shingles) of the classes in ``rows`` (row)."""
    wanted = stored(classes.join(stored(rows.distinct()), "row", "left_semi"))
    ids = stored(wanted.select("doc_id").distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    found = texts.select("text").mapInArrow(_sets, "s1 long, s2 long, shingles array<long>")
    # Copies of a text are merged before they are moved.
    found = found.groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"))
    return stored(found.join(wanted, ["s1", "s2"]).select("row", "shingles"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole shingle sets are similar enough."""
    pairs = stored(pairs)
    rows = pairs.select(F.col("a").alias("row")).union(pairs.select("b"))
    sets = _sets_of(docs, classes, rows)
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    whole = F.size("of_a") + F.size("of_b") - both
    near = pairs.join(left, "a").join(right, "b").where(100 * both >= PERCENT * whole)
    return near.select("a", "b")


def _buckets(postings: DataFrame) -> DataFrame:
    """The postings of keys that several classes hold, with how many do."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(postings.join(stored(sizes), "key"))


def _head_pairs(buckets: DataFrame) -> DataFrame:
    """Each class with the head of its buckets: the member that most others meet anywhere.

    A text that copies were made from meets them in more bands than they meet each other, so
    a group of near copies becomes one component without pairs among the copies.
    """
    met = stored(buckets.groupBy("row").agg(F.sum("size").alias("met")))
    heads = buckets.join(met, "row").groupBy("key")
    heads = stored(heads.agg(F.max_by(F.struct("row", "n"), F.struct("met", "row")).alias("head")))
    pairs = buckets.join(heads, "key").select(
        F.col("row").alias("a"), F.col("head.row").alias("b"), "n", F.col("head.n").alias("n_b")
    )
    pairs = pairs.where((F.col("a") != F.col("b")) & _similar_size("n", "n_b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed(postings: DataFrame) -> DataFrame:
    """The postings of keys that hold classes of several components."""
    spread = postings.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")
    )
    spread = stored(spread.where("low < high").select("key", "size"))
    return stored(postings.drop("size").join(spread, "key"))


def _pairs_across(buckets: DataFrame) -> DataFrame:
    """Pairs of classes of one bucket, of different components and of similar size.

    Sizes go by steps of 1.26, so similar sizes are in one step or in neighbouring ones.
    """
    step = F.floor(F.log("n") / float(np.log(1.26)))
    left = buckets.select("key", F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("in_a"), step.alias("step"))
    right = buckets.select(
        "key", F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("in_b"),
        step.alias("own"), F.explode(F.array(step, step - 1)).alias("step"),
    )
    pairs = left.join(right, ["key", "step"]).where(
        (F.col("in_a") != F.col("in_b"))
        & ((F.col("own") != F.col("step")) | (F.col("a") < F.col("b")))
        & _similar_size("n_a", "n_b")
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crowd_pairs(docs: DataFrame, classes: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs of the classes in ``crowd`` (row, n, root), of different components, that may link.

    Members of crowded buckets are alike, so bands hardly tell them apart. What does is the
    shingles that few of them hold: two linked sets have one in common among the rarest
    fifth of each, and from the first such on there must be enough left in both.
    """
    crowd = stored(crowd.distinct())
    sets = _sets_of(docs, classes, crowd.select("row"))
    held = crowd.join(sets, "row").select("row", "n", "root", F.explode("shingles").alias("shingle"))
    holders = stored(held.groupBy("shingle").agg(F.count("*").alias("holders")))
    rarest = Window.partitionBy("row").orderBy("holders", "shingle")
    ranked = held.join(holders, "shingle").withColumn("place", F.row_number().over(rarest) - 1)
    least = F.call_function("div", PERCENT * F.col("n") + 99, F.lit(100))
    ranked = ranked.where((F.col("place") <= F.col("n") - least) & (F.col("holders") > 1))
    postings = ranked.select("row", "n", "root", "place", F.col("shingle").alias("key"))
    postings = _mixed(stored(postings)).drop("size")
    a, b = (postings.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "n", "root", "place"))) for s in "ab")
    both = F.call_function(
        "div", PERCENT * (F.col("n_a") + F.col("n_b")) + 99 + PERCENT, F.lit(100 + PERCENT)
    )
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = a.join(b, "key").where(
        (F.col("row_a") < F.col("row_b")) & (F.col("root_a") != F.col("root_b")) & (room >= both)
        & _similar_size("n_a", "n_b")
    )
    return pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Size of each document's shingle set, the least doc_id linked to it by a chain, and if it stays.

    Sets of four-word shingles link when their Jaccard similarity is at least 0.8. Equal
    sets are one class. The signature of a class comes from two permutations, one of them
    shifted step by step; classes that agree in a band meet in its bucket. Each class is
    first checked with the head of its buckets. In buckets that then still hold several
    components, classes of different ones are checked, in crowded ones those that share
    a rare enough shingle, which all that link do. Pairs inside a component change nothing
    and are left out. All checks use the whole sets, so no wrong link is made.

    Null, empty and white-space texts have no shingles and link with nothing. Every row is a
    document of its own, also when it repeats another or its doc_id. Rows with a null doc_id
    take part in links; the component of nothing but such rows is null. ``kept`` is whether
    doc_id equals component_id, null counting as equal to null. Other columns are ignored;
    an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    described = docs.mapInArrow(_describe, DESCRIBED)
    described = stored(described.withColumn("row", F.monotonically_increasing_id()))
    with_words = described.where("n_shingles > 0")
    classes = stored(
        with_words.groupBy("s1", "s2").agg(
            F.min("doc_id").alias("doc_id"),
            F.min_by("row", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("row"),
        )
    )
    bands = described.join(classes.select("row"), "row", "left_semi")
    bands = stored(bands.select("row", F.col("n_shingles").alias("n"), "bands"))

    buckets = _buckets(bands.select("row", "n", F.explode("bands").alias("key")))
    links = stored(_verified(docs, classes, _head_pairs(buckets)))
    roots = stored(smallest_reachable(links))

    known = roots.withColumnRenamed("node", "row")
    rooted = buckets.join(known, "row", "left").select(
        "row", "n", "key", F.coalesce("root", "row").alias("root")
    )
    left = _mixed(stored(rooted))
    pairs = _pairs_across(left.where(F.col("size") <= CROWD))
    crowd = left.where(F.col("size") > CROWD).select("row", "n", "root")
    pairs = pairs.union(_crowd_pairs(docs, classes, crowd)).distinct()
    more = _verified(docs, classes, pairs)

    roots = smallest_reachable(stored(links.union(more)))
    placed = classes.join(roots.withColumnRenamed("node", "row"), "row", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "row")))
    least = stored(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    members = stored(placed.join(least, "root").select("s1", "s2", "component_id"))
    rows = described.select("doc_id", "n_shingles", "s1", "s2").join(members, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
