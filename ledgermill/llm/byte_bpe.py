"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 machine."""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from ledgermill.llm.common import slices

# Bounds of what a worker remembers: states, after which the machine no longer grows, and
# pairs of tokens and pieces, which are forgotten and filled again as needed.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 50_000, 300_000, 250_000
# Pieces remembered beside whole lists of ids, in stages that share workers with others.
FEW_PIECES = 60_000
# Pieces, and ids, of one text handled at once.
CHUNK = 50_000

ROOT = 0
_NEVER = 1 << 40
_IDS, _DIGITS = itemgetter(0), itemgetter(1)


class State:
    """A deterministic state: the tokenisations that the bytes read so far leave open.

    Each is (trie node of the bytes since its last token, that token, tokens not yet
    emitted). ``final`` is what the end of the piece emits.
    """

    __slots__ = ("final", "open", "steps")

    def __init__(self, open_: tuple):
        self.open = open_
        self.steps: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.final = next((pending for node, _, pending in open_ if node == ROOT), ())


class Transducer:
    """Bytes of a piece to token ids, one deterministic step for each byte.

    A sequence of tokens is what the merges make of its bytes exactly if each token, and
    each pair of neighbours, is what the merges make of its own bytes. So a machine that
    guesses where tokens end, and remembers the last one, accepts just that sequence. It
    is determinised as texts are read: a state is the set of guesses still open, and a
    token is emitted once all of them agree on it. A guess closes when no token goes on
    with its bytes, so the look ahead is less than the longest token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # The trie of all tokens: children and token, if any, by node.
        leaf: dict[int, int] = {}
        self.children, self.token_at = [{}], [-1]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                if not self.children[node]:
                    self.children[node] = {}
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append(leaf)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # Of each node the longest token that its bytes begin with; of each token the next
        # shorter one that it begins with, and its length.
        self.longest = [-1] * len(self.children)
        self.shorter = [-1] * (max(self.bytes_of) + 1)
        self.lengths = [0] * (max(self.bytes_of) + 1)
        waiting = [(ROOT, -1)]
        while waiting:
            node, above = waiting.pop()
            token = self.token_at[node]
            if token >= 0:
                self.shorter[token], self.lengths[token] = above, len(self.bytes_of[token])
                above = token
            self.longest[node] = above
            waiting += [(child, above) for child in self.children[node].values()]
        #: What two neighbours merge to, of all tokens that are two tokens side by side.
        self.joins: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                x, y = ranks.get(token[:cut]), ranks.get(token[cut:])
                if x is not None and y is not None:
                    self.joins[x << 32 | y] = rank
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.start = State(((ROOT, -1, ()),))
        self.states = {self.start.open: self.start}

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The merges of a rank under ``below`` carried out one by one, to compile a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks, none = self.ranks, len(self.ranks) * 2 if below is None else below
        while len(parts) > 1:
            rank, at = min(
                (ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1)
            )
            if rank >= none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, token: int) -> tuple[list, list] | None:
        """What stands at a token's left and right edge while it is merged: (token, rank of
        the merge that ends it) from the whole token down. None if no merges lead to it."""
        if token in self.edges:
            return self.edges[token]
        data = self.bytes_of[token]
        left, right = [(token, _NEVER)], [(token, _NEVER)]
        found: tuple[list, list] | None = (left, right)
        if len(data) > 1:
            parts = self.merged(data, token)
            below = [self.spines(self.ranks[p]) for p in parts] if len(parts) == 2 else [None]
            if None in below:
                found = None
            else:
                left += [(b, min(rank, token)) for b, rank in below[0][0]]
                right += [(b, min(rank, token)) for b, rank in below[1][1]]
        self.edges[token] = found
        return found

    def fits(self, last: int, token: int) -> bool:
        """Do the merges leave ``token`` whole after ``last`` (-1: at the start)?

        Merges run in order of rank, leftmost first. So one over the border happens
        exactly if its rank comes before those that end the two parts it would join.
        """
        key = (last + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            after = self.spines(token)
            before = self.spines(last) if last >= 0 else ((), ())
            known = after is not None and before is not None
            if known and last >= 0:
                known = not self._joined(before[1], after[0])
            self.pairs[key] = known
        return known

    def _joined(self, right: list, left: list) -> bool:
        """Does a merge take place between a right and a left edge?"""
        rank_of = self.joins.get
        for y, ends_y in left:
            for x, ends_x in right:
                rank = rank_of(x << 32 | y)
                if rank is not None and rank < ends_x and rank <= ends_y:
                    return True
        return False

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The next state and the tokens emitted, worked out once and then remembered."""
        nxt, ended = [], None
        for node, last, pending in state.open:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                nxt.append((child, last, pending))
            # One guess at most has a token end here.
            token = self.token_at[child]
            if ended is None and token >= 0 and self.fits(last, token):
                ended = (ROOT, token, (*pending, token))
        if ended is not None:
            nxt.append(ended)
        shortest = nxt[0][2]
        agreed = len(shortest)
        for _, _, pending in nxt:
            while pending[:agreed] != shortest[:agreed]:
                agreed -= 1
        emitted = shortest[:agreed]
        key = tuple([(node, last, pending[agreed:]) for node, last, pending in nxt])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(key)
        state.steps[byte] = to, emitted
        return to, emitted

    def follow(self, piece: bytes, path: list[int]) -> tuple[int, ...]:
        """The path of the machine through a piece from the tokens in ``path`` on, which all its
        guesses agree on. What comes then is tried one by one, the longest token first. Each place is reached by one path at most, so a place left is done with.

        Texts hold many pieces that never come again; no states are made for those.
        """
        children, longest, shorter, lengths = self.children, self.longest, self.shorter, self.lengths
        pairs, n = self.pairs, len(piece)
        at, left, token = sum([lengths[t] for t in path]), set(), -1
        before = (path[-1] + 1) << 32 if path else 0
        while at < n:
            if token < 0:
                node = ROOT
                for byte in piece[at:]:
                    child = children[node].get(byte)
                    if child is None:
                        break
                    node = child
                token = longest[node]
            while token >= 0:
                fit = pairs.get(before | token)
                if fit is None:
                    fit = self.fits((before >> 32) - 1, token)
                if fit and at + lengths[token] not in left:
                    path.append(token)
                    at += lengths[token]
                    before = (token + 1) << 32
                    token = -1
                    break
                token = shorter[token]
            else:
                # No token goes on from here: give up the last one for a shorter one.
                while token < 0:
                    left.add(at)
                    token = path.pop()
                    at -= lengths[token]
                    token = shorter[token]
                before = (path[-1] + 1) << 32 if path else 0
        return tuple(path)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self.start, []
        for byte in piece:
            found = state.steps.get(byte)
            if found is None:
                # One new step for each piece: the machine grows where pieces agree.
                if len(self.states) < MAX_STATES:
                    self.step(state, byte)
                return self.follow(piece, out)
            state, emitted = found
            if emitted:
                out += emitted
        return (*out, *state.final)


def _utf8_table() -> np.ndarray:
    """Next state by state and byte. 0: between characters, 8: not UTF-8."""
    table = np.full((9, 256), 8, np.int8)
    table[0, 0x00:0x80] = 0
    for first, last, state in (
        (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
        (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7),
    ):
        table[0, first : last + 1] = state
    for state, first, last, to in (
        (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1),
        (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ):
        table[state, first : last + 1] = to
    return table


UTF8 = _utf8_table().tolist()


class Decoder:
    """Ids to UTF-8 bytes as they come; bytes of an unfinished character are held back."""

    def __init__(self, bytes_of: dict[int, bytes], effects: dict[int, list[int]]):
        self.bytes_of, self.effects = bytes_of, effects
        self.state, self.held, self.valid = 0, b"", True

    def feed(self, ids: list[int]) -> bytes:
        """The bytes that are complete characters by now.

        ``effects`` tells where a token leads from each state, for the tokens that do not
        consist of whole characters.
        """
        state, effects = self.state, self.effects
        if state == 0 and effects.keys().isdisjoint(ids):
            return b"".join(map(self.bytes_of.__getitem__, ids))
        whole = at = 0
        for k in [k for k, token in enumerate(ids) if token in effects]:
            if state and k > at:
                # Whole characters inside an unfinished one.
                state = 8
            state = effects[ids[k]][state]
            at = k + 1
            if state in (0, 8):
                whole = at
        if at < len(ids):
            state, whole = 8 if state else 0, len(ids)
        self.state, self.valid = state, state != 8
        done, left = ids[:whole], ids[whole:]
        data = b"".join(map(self.bytes_of.__getitem__, done))
        rest = b"".join(map(self.bytes_of.__getitem__, left))
        if whole:
            data, self.held = self.held + data, rest
        else:
            self.held += rest
        return data

    def finish(self) -> bytes:
        """What is left; a character cut off makes the text invalid."""
        self.valid = self.valid and self.state == 0
        held, self.held = self.held, b""
        return held


class Codec:
    """A rank file and pattern made ready in a worker."""

    def __init__(self, rank_file: bytes, pattern: str, pieces: int = MAX_PIECES):
        self.most_pieces = pieces
        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in rank_file.splitlines() if line.strip())
        }
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self.effects: dict[int, list[int]] = {}
        for token, rank in ranks.items():
            ends = [self._end(state, token) for state in range(9)]
            if ends[0] != 0:
                self.effects[rank] = ends
        # The tables above hold many small objects that live on; look them over less often.
        gc.freeze()
        gc.set_threshold(200_000, 100, 100)

    @staticmethod
    def _end(state: int, token: bytes) -> int:
        for byte in token:
            state = UTF8[state][byte]
        return state

    def coded(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        """Ids of each piece of a text, also as digits with commas, some pieces at a time."""
        encode = self.machine.encode
        found = (m.group() for m in self.pattern.finditer(text))
        if len(text) < CHUNK:
            found = iter(self.pattern.findall(text))
        while chunk := list(islice(found, CHUNK)):
            if len(self.pieces) >= self.most_pieces:
                self.older, self.pieces = self.pieces, {}
            pieces, older = self.pieces, self.older.get
            out = list(map(pieces.get, chunk))
            if None in out:
                for k, both in enumerate(out):
                    if both is not None:
                        continue
                    piece = chunk[k]
                    both = older(piece)
                    if both is None:
                        ids = encode(piece.encode())
                        both = ids, ",".join(map(str, ids))
                    out[k] = both
                    if len(piece) < 64:
                        pieces[piece] = both
            yield out

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, some pieces at a time."""
        for part in self.coded(text):
            yield list(chain.from_iterable(map(_IDS, part)))

    def decoder(self) -> Decoder:
        return Decoder(self.machine.bytes_of, self.effects)


_codecs: dict[bytes, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _forget() -> None:
    """Gives up a task's codec, so that idle workers hold no memory that others need."""
    gc.unfreeze()
    gc.collect()
    gc.set_threshold(2000, 10, 10)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        # What was freed stays with the process until the C library is asked to return it.
        ctypes.CDLL(None).malloc_trim(0)


class ByteBpe:
    """Encodes and decodes by the ranks in the file at ``path``, after splitting by ``pattern``.

    The file is read once, by the driver, and sent to the tasks: its size is that of the
    vocabulary. Everything is done row by row where the rows lie. Null and empty texts
    have no tokens. Other columns, null ids and repeated rows are carried through.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self._sent = spark.sparkContext.broadcast((file.read(), pattern))

    def encode(self, docs: DataFrame, column: str = "text", to: str = "token_ids") -> DataFrame:
        """``docs`` with the token ids of ``column`` in ``to``, and in ``decodes`` whether they
        decode to it; columns of these names are replaced."""
        sent = self._sent
        fields = [f for f in docs.schema.fields if f.name not in (to, "decodes")]
        new = [StructField(to, ArrayType(IntegerType())), StructField("decodes", BooleanType())]
        schema = StructType([*fields, *new])
        names = schema.fieldNames()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = Codec(*sent.value, FEW_PIECES)
            for batch in slices(batches, column):
                texts = batch.column(column).to_pylist()
                ids, decodes = [], []
                for text in texts:
                    found, right = _checked(codec, text or "")
                    ids.append(found)
                    decodes.append(right)
                kept = [batch.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(ids, pa.list_(pa.int32())), pa.array(decodes)], names=names
                )
            del codec
            _forget()

        return docs.mapInArrow(run, schema)

    def decode(self, encoded: DataFrame, column: str = "token_ids") -> DataFrame:
        """``encoded`` with ``decoded`` text and ``decoded_valid``.

        Bytes that are no UTF-8 become replacement characters and make it invalid. Null
        ids give an empty text. Ids outside the vocabulary raise an error.
        """
        sent = self._sent
        fields = [f for f in encoded.schema.fields if f.name not in ("decoded", "decoded_valid")]
        names = [f.name for f in fields] + ["decoded", "decoded_valid"]
        schema = ", ".join(
            [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
            + ["decoded string", "decoded_valid boolean"]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(*sent.value)
            for batch in batches:
                texts, valid = [], []
                for ids in batch.column(column).to_pylist():
                    decoder = codec.decoder()
                    data = decoder.feed(ids or []) + decoder.finish()
                    texts.append(data.decode("utf-8", "replace"))
                    valid.append(decoder.valid)
                kept = [batch.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(texts), pa.array(valid)], names=names
                )

        return encoded.mapInArrow(run, schema)

    def digests(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs`` (doc_id, text) the number of tokens, and SHA-256 of the ids
        and of what the ids decode to; ids pass through a text in pieces of bounded size."""
        sent = self._sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(*sent.value)
            for batch in slices(batches, "text"):
                rows = [_digest(codec, t or "") for t in batch.column("text").to_pylist()]
                n, ids, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

        return docs.select("doc_id", "text").mapInArrow(
            run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        )


def _checked(codec: Codec, text: str) -> tuple[np.ndarray, bool]:
    """The ids of a text, and whether they decode to it, compared as they come."""
    parts, decoder, wanted, at = [], codec.decoder(), text.encode(), 0
    right = True
    for part in codec.encode(text):
        parts.append(np.array(part, np.int32))
        data = decoder.feed(part)
        right = right and wanted[at : at + len(data)] == data
        at += len(data)
    rest = decoder.finish()
    right = right and wanted[at:] == rest
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), right


def _digest(codec: Codec, text: str) -> tuple[int, str, str]:
    n, of_ids, of_bytes, decoder = 0, hashlib.sha256(), hashlib.sha256(), codec.decoder()
    for part in codec.coded(text):
        ids = list(chain.from_iterable(map(_IDS, part)))
        of_ids.update((("," if n else "") + ",".join(map(_DIGITS, part))).encode())
        of_bytes.update(decoder.feed(ids))
        n += len(ids)
    of_bytes.update(decoder.finish())
    return n, of_ids.hexdigest(), of_bytes.hexdigest()
