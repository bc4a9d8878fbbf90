"""Short codes for vectors: a codebook per part, trained over metric trees of anchors.

Vectors are cut into parts, and each part of a vector is named by the nearest of a few
entries. Every task builds one tree per part over some thousand vectors: anchors are chosen
and take over points nearer to them, the balls around them are merged upwards two by two and
split downwards by the same rule. A ball keeps the sum and number of its points. In a round
of training a ball hands the entries that can still be nearest to the balls inside it, and
one with a single entry left adds its sum and number to it whole.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import expand, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Vectors under one set of trees, and points of a ball that is not split.
CHUNK, LEAF = 4096, 32
# Greatest size of a whole component; distances of longer vectors may not fit in 64 bits.
GREATEST = 2**24


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of every component."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() > GREATEST:
        raise ValueError(f"a component is larger than {GREATEST // SCALE}")
    return scaled.astype(np.int64)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1, dtype=np.float64))


def choose_anchors(points: np.ndarray, k: int) -> np.ndarray:
    """The number of each point's anchor, of at most ``k``.

    The next anchor is the point farthest from its own. It takes every point that is nearer
    to it; points within half the way from their anchor to the new one cannot be, so their
    distances are not worked out.
    """
    pivots = [0]
    owner = np.zeros(len(points), np.int64)
    far = _distances(points, points[0])
    while len(pivots) < k:
        new = int(far.argmax())
        if far[new] == 0:
            break
        between = _distances(points[pivots], points[new])
        reach = np.flatnonzero(far >= between[owner] / 2)
        to_new = _distances(points[reach], points[new])
        taken = to_new < far[reach]
        far[reach[taken]] = to_new[taken]
        owner[reach[taken]] = len(pivots)
        pivots.append(new)
    return owner


def _merge_order(balls: list[tuple[np.ndarray, float]]) -> list[tuple[int, int]]:
    """Which two balls (centre, radius) to join next, those in the smallest common ball first."""
    k = len(balls)
    centre = np.zeros((2 * k - 1, len(balls[0][0])))
    radius = np.zeros(2 * k - 1)
    for i, (c, r) in enumerate(balls):
        centre[i], radius[i] = c, r
    open_ = np.arange(2 * k - 1) < k
    cost = np.full((2 * k - 1, 2 * k - 1), np.inf)
    for i in range(1, k):
        cost[i, :i] = _distances(centre[:i], centre[i]) + radius[:i] + radius[i]
    merges = []
    for new in range(k, 2 * k - 1):
        a, b = divmod(int(cost[:new, :new].argmin()), new)
        merges.append((a, b))
        apart = float(np.linalg.norm(centre[a] - centre[b]))
        radius[new] = max(radius[a], radius[b], (apart + radius[a] + radius[b]) / 2)
        # The new centre lies on the line between the two, as far as the balls ask for.
        along = (radius[new] - radius[a]) / apart if apart else 0.0
        centre[new] = centre[a] + min(max(along, 0.0), 1.0) * (centre[b] - centre[a])
        open_[[a, b]] = False
        cost[[a, b]] = cost[:, [a, b]] = np.inf
        left = np.flatnonzero(open_[:new])
        cost[new, left] = _distances(centre[left], centre[new]) + radius[left] + radius[new]
        open_[new] = True
    return merges


class AnchorTree:
    """Balls over points, each over a run of ``order``, with centre, radius, sum and number."""

    FIELDS = ("order", "low", "high", "left", "right", "centre", "radius", "sums")

    def __init__(self, points: np.ndarray):
        self._points = points
        self._order: list[np.ndarray] = []
        self._nodes: list[list[int]] = []
        self._count = 0
        self._build(np.arange(len(points)))
        self.order = np.concatenate(self._order)
        self.low, self.high, self.left, self.right = np.array(self._nodes, np.int64).T
        total = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points[self.order], axis=0, out=total[1:])
        self.sums = total[self.high] - total[self.low]
        self.centre = self.sums / (self.high - self.low)[:, None]
        self.radius = np.array(
            [
                _distances(points[self.order[a:b]], c).max()
                for a, b, c in zip(self.low, self.high, self.centre, strict=True)
            ]
        )
        del self._points, self._order, self._nodes

    def _node(self, low: int, left: int = -1, right: int = -1) -> int:
        self._nodes.append([low, self._count, left, right])
        return len(self._nodes) - 1

    def _build(self, ids: np.ndarray) -> int:
        """Adds the ball of these points after those it holds; the number of its node."""
        low = self._count
        points = self._points[ids]
        anchors = choose_anchors(points, int(np.sqrt(len(ids))) + 1) if len(ids) > LEAF else None
        if anchors is None or not anchors.any():
            self._order.append(ids)
            self._count += len(ids)
            return self._node(low)
        groups = [ids[anchors == k] for k in range(anchors.max() + 1)]
        groups = [g for g in groups if len(g)]
        balls = []
        for group in groups:
            centre = self._points[group].mean(axis=0)
            balls.append((centre, float(_distances(self._points[group], centre).max())))
        # From the middle out: the balls are joined upwards, and each is split downwards.
        return self._join(groups, _merge_order(balls), 2 * len(groups) - 2)

    def _join(self, groups: list[np.ndarray], merges: list[tuple[int, int]], at: int) -> int:
        """The node of group or merge ``at``, with an own stack as merges may form a long chain."""
        done: dict[int, tuple[int, int]] = {}
        stack = [(at, False)]
        while stack:
            top, ready = stack.pop()
            if top < len(groups):
                low = self._count
                done[top] = (self._build(groups[top]), low)
            elif ready:
                (a, low), (b, _) = (done.pop(i) for i in merges[top - len(groups)])
                done[top] = (self._node(low, a, b), low)
            else:
                a, b = merges[top - len(groups)]
                stack += [(top, True), (b, False), (a, False)]
        return done[at][0]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> AnchorTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data), allow_pickle=False) as fields:
            for name in cls.FIELDS:
                setattr(tree, name, fields[name])
        return tree

    def owners(
        self, points: np.ndarray, entries: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls with the one entry that owns each, and the points left over with theirs.

        Goes down all balls of a depth together. An entry leaves a ball's list when the whole
        ball lies on the side of the plane midway to a nearer entry, surely so despite
        rounding; of equal entries the first stays. No point that could have it nearest, or
        as near, is in such a ball. Left over are the points of leaves with more entries.
        """
        apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(axis=2, dtype=np.float64))
        first = (apart == 0).argmax(axis=1) == np.arange(len(entries))
        nodes = np.array([len(self.low) - 1])
        listed = first[None]
        whole, whole_entry, rest, rest_entry = ([np.zeros(0, np.int64)] for _ in range(4))
        while len(nodes):
            far = ((self.centre[nodes][:, None] - entries[None]) ** 2).sum(axis=2)
            far[~listed] = np.inf
            best = far.argmin(axis=1)
            ahead = far - far[np.arange(len(nodes)), best][:, None]
            reach = 2 * self.radius[nodes][:, None] * apart[best]
            listed = listed & ~(ahead > reach + 1e-9 * (far + reach) + 1e-6)
            alone = listed.sum(axis=1) == 1
            whole.append(nodes[alone])
            whole_entry.append(best[alone])
            leaf = ~alone & (self.left[nodes] < 0)
            if leaf.any():
                ids, entry = self._nearest_in_leaves(points, entries, nodes[leaf], listed[leaf])
                rest.append(ids)
                rest_entry.append(entry)
            inner = ~alone & ~leaf
            nodes = np.concatenate([self.left[nodes[inner]], self.right[nodes[inner]]])
            listed = np.concatenate([listed[inner]] * 2)
        return tuple(np.concatenate(x) for x in (whole, whole_entry, rest, rest_entry))

    def _nearest_in_leaves(self, points, entries, leaves, listed) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.high[leaves] - self.low[leaves]
        ids = self.order[expand(self.low[leaves], sizes)]
        far = ((points[ids][:, None] - entries[None]) ** 2).sum(axis=2)
        far[~np.repeat(listed, sizes, axis=0)] = np.iinfo(np.int64).max
        return ids, far.argmin(axis=1)

    def totals(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Per entry the sums of the points nearest to it; last, their number."""
        balls, ball_entry, ids, entry = self.owners(points, entries)
        total = np.zeros((len(entries), points.shape[1] + 1), np.int64)
        np.add.at(total[:, :-1], ball_entry, self.sums[balls])
        np.add.at(total[:, -1], ball_entry, self.high[balls] - self.low[balls])
        np.add.at(total[:, :-1], entry, points[ids])
        np.add.at(total[:, -1], entry, 1)
        return total

    def nearest(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The entry nearest to each point, the first of those as near."""
        balls, ball_entry, ids, entry = self.owners(points, entries)
        sizes = self.high[balls] - self.low[balls]
        out = np.empty(len(points), np.int64)
        out[self.order[expand(self.low[balls], sizes)]] = np.repeat(ball_entry, sizes)
        out[ids] = entry
        return out


def _part(points: np.ndarray, part: int) -> np.ndarray:
    width = points.shape[1] // PARTS
    return points[:, part * width : (part + 1) * width]


def _plant(schema: pa.Schema) -> Callable:
    """Task function: chunks of vectors with a tree per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False)
                points = whole_numbers(flat.reshape(rows.num_rows, -1))
                trees = [AnchorTree(_part(points, p)).to_bytes() for p in range(PARTS)]
                one = pa.array([0, rows.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.ListArray.from_arrays(one, rows.column(c)) for c in ("vec_id", "label")),
                        pa.array([points.tobytes()], pa.binary()),
                        pa.array([trees], pa.list_(pa.binary())),
                    ],
                    schema=schema,
                )

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, labels, points and trees of each chunk."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels = (batch.column(c).slice(k, 1).flatten() for c in ("vec_id", "label"))
            points = np.frombuffer(batch.column("points")[k].as_buffer(), np.int64)
            points = points.reshape(len(ids), -1)
            trees = (AnchorTree.from_bytes(t.as_py()) for t in batch.column("trees")[k].values)
            yield ids, labels, points, trees


def _add_up(codebooks: np.ndarray) -> Callable:
    """Task function: the sums of each part, entry and place; place -1 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, points, trees in _chunks(batches):
            found = np.stack(
                [t.totals(_part(points, p), codebooks[p]) for p, t in enumerate(trees)]
            )
            total = found if total is None else total + found
        if total is not None:
            part, entry, place = (x.ravel() for x in np.indices(total.shape))
            place = np.where(place == total.shape[2] - 1, -1, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (part, entry, place, total.ravel())],
                names=["part", "entry", "place", "total"],
            )

    return run


def _encode(codebooks: np.ndarray) -> Callable:
    """Task function: code and error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, points, trees in _chunks(batches):
            codes = np.empty((len(ids), PARTS), np.uint8)
            error = np.zeros(len(ids), np.int64)
            for p, tree in enumerate(trees):
                own = _part(points, p)
                codes[:, p] = tree.nearest(own, codebooks[p])
                error += ((own - codebooks[p][codes[:, p]]) ** 2).sum(axis=1)
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(text, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """The rows whose vector has no null and only finite components."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = embeddings.select("vec_id", "label", F.col("embedding").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


class VectorCodes:
    """Codebooks learned from ``embeddings``, and the codes of all its rows."""

    def __init__(self, embeddings: DataFrame):
        kept = kept_vectors(embeddings)
        order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
        fits = (F.size("vector") > 0) & (F.size("vector") % PARTS == 0)
        first = kept.where(fits).orderBy(*order).select(F.size("vector")).first()
        self._kinds = ", ".join(
            f"{name} {kept.schema[name].dataType.simpleString()}" for name in ("vec_id", "label")
        )
        self.codebooks = None
        if first is None:
            self._coded = embeddings.sparkSession.createDataFrame(
                [], f"{self._kinds}, code string, error long"
            )
            return
        kept = kept.where(F.size("vector") == first[0])
        start = [row.vector for row in kept.orderBy(*order).limit(ENTRIES).collect()]
        start = whole_numbers(np.array(start, np.float64))
        books = np.stack([_part(start, p) for p in range(PARTS)])
        chunks = self._planted(kept)
        for _ in range(ROUNDS):
            books = self._round(chunks, books)
        self.codebooks = books
        self._coded = chunks.mapInArrow(_encode(books), f"{self._kinds}, code string, error long")

    @staticmethod
    def _planted(kept: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        ids, labels = (kept.schema[c].dataType for c in ("vec_id", "label"))
        schema = pa.schema(
            [
                ("vec_id", pa.list_(to_arrow_type(ids))),
                ("label", pa.list_(to_arrow_type(labels))),
                ("points", pa.binary()),
                ("trees", pa.list_(pa.binary())),
            ]
        )
        ddl = (
            f"vec_id array<{ids.simpleString()}>, label array<{labels.simpleString()}>, "
            "points binary, trees array<binary>"
        )
        return stored(kept.mapInArrow(_plant(schema), ddl))

    @staticmethod
    def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
        """The codebooks after one round. What reaches the driver is one number per component."""
        sums = chunks.mapInArrow(_add_up(books), "part long, entry long, place long, total long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        found = {(r.part, r.entry, r.place): r.total for r in sums.collect()}
        after = books.copy()
        for part, entry, place in np.ndindex(books.shape):
            if count := found[part, entry, -1]:
                after[part, entry, place] = found[part, entry, place] // count
        return after

    def digest(self) -> str:
        """SHA-256 of all components of all entries."""
        numbers = self.codebooks.ravel().tolist() if self.codebooks is not None else []
        return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """Code, error, summed error of the label, and digest of the codebooks per kept row.

        Rows whose vector is null, holds null or a component that is not finite are left out,
        and so are those with a number of components other than that of the least vec_id's
        vector that can be cut into equal parts. Ids that repeat are coded row by row, and
        start the codebooks in order of their vectors; null ids come last. Rows of one label,
        or of none, share the sum. With fewer rows than entries there are as many
        entries as rows. Components beyond 4096 raise an error, since distances may
        then not fit. Other columns are ignored; an empty table gives an empty result.
        """
        coded = stored(self._coded)
        sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
        joined = coded.join(sums, coded["label"].eqNullSafe(sums["label"]))
        return joined.select(
            "vec_id", "code", "error", "label_error", F.lit(self.digest()).alias("codebooks_sha256")
        )
