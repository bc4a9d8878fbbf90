"""Language ID: a bidirectional gated recurrent network over bytes, trained by hand in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgermill.llm.common import expand, slices, text_buffers

# Bytes read by one step of the network; each step is a position with a label of its own.
STRIDE = 4
# Units in each direction, and steps run as one sequence when predicting and training.
UNITS, STEPS, TRAIN_STEPS = 12, 128, 48
# The sample learned from: documents of each language, characters of each, and the
# languages with most documents.
DOCS_PER_LANG, CHARS_PER_DOC, MOST_LANGS = 250, 1500, 64
ROUNDS, BATCH, RATE = 220, 128, 0.02
UNKNOWN = "und"
# Bytes of text whose sequences run side by side.
BLOCK_BYTES = 1024 * 1024


@dataclass
class Direction:
    """Weights of one direction; the input of a step is a sum of rows chosen by its bytes."""

    table: np.ndarray  # STRIDE x 256 x 3 units: update, reset, candidate
    back: np.ndarray  # units x 3 units
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.back, self.bias]


@dataclass
class Network:
    langs: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.forward.arrays(), *self.backward.arrays(), self.out, self.out_bias]


def new_network(langs: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    def direction() -> Direction:
        return Direction(
            draw(STRIDE, 256, 3 * UNITS, scale=0.1),
            draw(UNITS, 3 * UNITS, scale=UNITS**-0.5),
            np.zeros(3 * UNITS, np.float32),
        )

    out = draw(2 * UNITS, len(langs), scale=0.2)
    return Network(langs, direction(), direction(), out, np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(d: Direction, steps: np.ndarray, mask: np.ndarray, order, keep: bool):
    """States (steps x sequences x units) of one direction; with ``keep`` all that learning needs.

    ``steps`` is steps x sequences x STRIDE bytes, ``mask`` steps x sequences. Steps that are
    only padding leave a zero state.
    """
    n, u = steps.shape[1], UNITS
    state = np.zeros((n, u), np.float32)
    states = np.empty((len(steps), n, u), np.float32)
    kept = []
    for t in order:
        a = d.table[0][steps[t, :, 0]]
        for k in range(1, STRIDE):
            a += d.table[k][steps[t, :, k]]
        a += d.bias
        gates = a[:, : 2 * u]
        gates += state @ d.back[:, : 2 * u]
        gates = _sigmoid(gates)
        update, reset = gates[:, :u], gates[:, u:]
        held = reset * state
        candidate = np.tanh(a[:, 2 * u :] + held @ d.back[:, 2 * u :])
        nxt = (state + update * (candidate - state)) * mask[t][:, None]
        if keep:
            kept.append((t, state, update, reset, held, candidate))
        states[t] = state = nxt
    return states, kept


def _learn(d: Direction, steps, mask, kept, wanted: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction's weights, back through time from those of its states."""
    u = UNITS
    grads = [np.zeros_like(x) for x in d.arrays()]
    into = np.zeros(steps.shape[:2] + (3 * u,), np.float32)
    later = np.zeros(wanted.shape[1:], np.float32)
    for t, state, update, reset, held, candidate in reversed(kept):
        g = (wanted[t] + later) * mask[t][:, None]
        to_candidate = g * update * (1 - candidate**2)
        to_held = to_candidate @ d.back[:, 2 * u :].T
        to_update = g * (candidate - state) * update * (1 - update)
        to_reset = to_held * state * reset * (1 - reset)
        gates = np.concatenate([to_update, to_reset], axis=1)
        later = g * (1 - update) + to_held * reset + gates @ d.back[:, : 2 * u].T
        grads[1][:, : 2 * u] += state.T @ gates
        grads[1][:, 2 * u :] += held.T @ to_candidate
        into[t, :, : 2 * u], into[t, :, 2 * u :] = gates, to_candidate
    flat = into.reshape(-1, 3 * u)
    grads[2] += flat.sum(axis=0)
    for k in range(STRIDE):
        byte = steps[:, :, k].ravel()
        order = np.argsort(byte, kind="stable")
        present, starts = np.unique(byte[order], return_index=True)
        grads[0][k][present] = np.add.reduceat(flat[order], starts)
    return grads


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[bytes, str]], seed: int = 7) -> Network | None:
    """Learns from (bytes, lang) pairs by backpropagation through time; None without any."""
    samples = [(np.frombuffer(b, np.uint8), lang) for b, lang in samples if b]
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    network, rng = new_network(langs, seed), np.random.default_rng(seed)
    by_lang = [[b for b, lang in samples if lang == x] for x in langs]
    weights = network.arrays()
    mean, spread = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for turn in range(1, ROUNDS + 1):
        labels = rng.integers(0, len(langs), BATCH)
        steps = np.zeros((BATCH, TRAIN_STEPS * STRIDE), np.uint8)
        mask = np.zeros((TRAIN_STEPS, BATCH), np.float32)
        for i, label in enumerate(labels):
            text = by_lang[label][rng.integers(len(by_lang[label]))]
            at = int(rng.integers(0, max(1, len(text) - TRAIN_STEPS * STRIDE + 1)))
            piece = text[at : at + TRAIN_STEPS * STRIDE]
            steps[i, : len(piece)] = piece
            mask[: -(-len(piece) // STRIDE), i] = 1
        steps = steps.reshape(BATCH, TRAIN_STEPS, STRIDE).transpose(1, 0, 2)
        grads = _gradients(network, steps, mask, labels)
        rate = RATE * min(1.0, 2 * (1 - turn / (ROUNDS + 1)))
        for w, g, m, v in zip(weights, grads, mean, spread, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            step = m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
            w -= (rate * step).astype(np.float32)
    return network


def _gradients(network: Network, steps, mask, labels) -> list[np.ndarray]:
    n = len(steps)
    ahead, kept_ahead = _run(network.forward, steps, mask, range(n), True)
    behind, kept_behind = _run(network.backward, steps, mask, reversed(range(n)), True)
    both = np.concatenate([ahead, behind], axis=2)
    wrong = _softmax(both @ network.out + network.out_bias)
    wrong[:, np.arange(len(labels)), labels] -= 1
    wrong *= mask[:, :, None] / mask.sum()
    flat = wrong.reshape(-1, wrong.shape[2])
    to_states = wrong @ network.out.T
    return [
        *_learn(network.forward, steps, mask, kept_ahead, to_states[:, :, :UNITS]),
        *_learn(network.backward, steps, mask, kept_behind, to_states[:, :, UNITS:]),
        both.reshape(-1, 2 * UNITS).T @ flat,
        flat.sum(axis=0),
    ]


def label_positions(network: Network, data: np.ndarray, offsets: np.ndarray):
    """Probabilities of the languages at every position of each text, and each one's text.

    A text is cut into sequences of ``STEPS`` positions, each seen from both of its ends.
    """
    sizes = np.diff(offsets)
    positions = -(-sizes // STRIDE)
    sequences = -(-positions // STEPS)
    first = np.concatenate([[0], np.cumsum(sequences)])
    width = STEPS * STRIDE
    padded = np.zeros(int(first[-1]) * width, np.uint8)
    padded[expand(first[:-1] * width, sizes)] = data
    used = np.zeros(int(first[-1]) * STEPS, bool)
    used[expand(first[:-1] * STEPS, positions)] = True
    steps = padded.reshape(-1, STEPS, STRIDE)
    used = used.reshape(-1, STEPS)
    out = np.empty((len(steps), STEPS, len(network.langs)), np.float32)
    side = max(1, BLOCK_BYTES // width)
    for at in range(0, len(steps), side):
        part = np.ascontiguousarray(steps[at : at + side].transpose(1, 0, 2))
        mask = np.ascontiguousarray(used[at : at + side].T).astype(np.float32)
        ahead, _ = _run(network.forward, part, mask, range(STEPS), False)
        behind, _ = _run(network.backward, part, mask, reversed(range(STEPS)), False)
        scores = ahead @ network.out[:UNITS]
        scores += behind @ network.out[UNITS:]
        out[at : at + side] = _softmax(scores + network.out_bias).transpose(1, 0, 2)
    return out[used], np.repeat(np.arange(len(sizes)), positions)


def classify(network: Network, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of each text, the mean over its positions."""
    data, offsets = text_buffers(column)
    probabilities, owner = label_positions(network, data, offsets)
    n = len(offsets) - 1
    pooled = np.stack(
        [np.bincount(owner, p, minlength=n) for p in probabilities.T.astype(np.float64)], axis=1
    )
    pooled = pooled / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
    best = pooled.argmax(axis=1)
    return [network.langs[k] for k in best], np.minimum(pooled[np.arange(n), best], 1.0)


def held_out(doc_id: str = "doc_id"):
    """Is a document kept from learning? A null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """The bounded sample of labelled documents that the network is trained on: of each of the
    ``MOST_LANGS`` commonest languages ``DOCS_PER_LANG`` documents by hash of their id, and
    ``CHARS_PER_DOC`` characters from a place in each that the hash gives."""
    labelled = docs.where("doc_id is not null and lang is not null and text is not null")
    labelled = labelled.where(~held_out())
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    langs = [r[0] for r in common.collect()]
    by_hash = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = (
        labelled.where(F.col("lang").isin(langs))
        .select("doc_id", "lang", F.xxhash64("doc_id").alias("place"))
        .withColumn("rank", F.row_number().over(by_hash))
        .where(F.col("rank") <= DOCS_PER_LANG)
        .select("doc_id", "lang", "place")
    )
    start = F.pmod("place", F.greatest(F.length("text") - CHARS_PER_DOC, F.lit(1))).cast("int") + 1
    texts = labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select(
        "doc_id", "lang", F.substring(F.col("text"), start, F.lit(CHARS_PER_DOC)).alias("piece")
    ).orderBy("doc_id", "lang", "piece").limit(len(langs) * DOCS_PER_LANG)
    return [(r.piece.encode(), r.lang) for r in rows.collect()]


class LanguageId:
    """Predicts by a network trained on a sample of ``docs`` (doc_id, text, lang).

    A prediction rests on the whole text alone. Null texts and those without a letter are
    ``und`` with score 0, as is every text if there was nothing to learn from. Repeated
    rows are predicted each for itself; an empty table gives none.
    """

    def __init__(self, docs: DataFrame):
        self.network = train(sample(docs))
        self._sent = docs.sparkSession.sparkContext.broadcast(self.network)

    def predict(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
        sent = self._sent
        fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
        named = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lang_pred")
        kept = docs.select(*[f"`{f.name}`" for f in fields], named)
        new = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
        schema = StructType([*fields, *new])
        names = schema.fieldNames()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network = sent.value
            for batch in slices(batches, "text"):
                has_letter = batch.column("lang_pred").to_pylist()
                n = batch.num_rows
                found, scores = [UNKNOWN] * n, np.zeros(n)
                if network is not None:
                    found, scores = classify(network, batch.column("text"))
                found = [x if y else UNKNOWN for x, y in zip(found, has_letter, strict=True)]
                scores = np.where(has_letter, scores, 0.0)
                columns = [batch.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.string()), pa.array(scores)], names=names
                )

        return kept.mapInArrow(run, schema)
