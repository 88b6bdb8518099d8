"""Byte-level BPE: texts to token ids and back, as the rank file defines them.

Pre-tokenisation uses no regular expression. Code points get classes from a table, a class that depends on the next
character is refined by shifted comparisons, and a small automaton decides where pieces begin. Its transition functions
are composed block by block (composition is associative): all blocks run side by side for every start state, the block
functions are chained, and one more pass gives the state before each character.

Pieces are slices of the bytes. Each distinct piece is merged once per worker as long as the bounded cache keeps it; the
ids of a text are then gathered from the cache's pool in one array operation. Byte offsets of all tokens are kept, so
any run of tokens can be decoded to its place in the text.

The rank file is read on each worker from ``vocabulary``, a path or a name that the installed package of public
tokenizers resolves. There is no shuffle; memory is bounded by the Arrow batch, the chunk or longest text and the cache.

Defined results: null text is empty and has no tokens. Repeated rows are encoded one by one. Special tokens in a text
are ordinary text. Other columns of the input take no part in ``encode`` and ``digests``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripleframe.llm import arrow_text as at
from tripleframe.llm.common import only

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_PIECES = 250_000
BLOCK = 256

# classes of a code point; the second group depends on the next character
LETTER, SHORT, PAIR, NUMBER, OTHER, QUOTE, SPACE, WHITE = range(8)
JOINED, ALONE, RUN = 6, 7, 8
N_CLASSES = 9
# states after a code point
START, IN_LETTERS, IN_NUMBER, IN_OTHER, FRESH_QUOTE, HALF_SHORT, DONE, AFTER_JOINED, IN_WHITE = range(9)
N_STATES = 9


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point: letters and numbers by Unicode category, white space by property."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    # The code points with the White_Space property.
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = WHITE
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    out[[ord(c) for c in "stmd"]] = SHORT
    return out


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, piece begins here), both by class and state; classes of a text's first character follow the others."""
    step = np.zeros((2 * N_CLASSES, N_STATES), dtype=np.uint8)
    begins = np.ones((2 * N_CLASSES, N_STATES), dtype=bool)
    plain = {LETTER: IN_LETTERS, SHORT: IN_LETTERS, PAIR: IN_LETTERS, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    plain |= {QUOTE: FRESH_QUOTE, JOINED: AFTER_JOINED, ALONE: DONE, RUN: IN_WHITE}
    for kind, state in plain.items():
        step[kind] = state
        step[kind + N_CLASSES] = state
    for kind in (LETTER, SHORT, PAIR):
        begins[kind, [IN_LETTERS, AFTER_JOINED, HALF_SHORT]] = False
        step[kind, HALF_SHORT] = DONE
    step[SHORT, FRESH_QUOTE], begins[SHORT, FRESH_QUOTE] = DONE, False
    step[PAIR, FRESH_QUOTE], begins[PAIR, FRESH_QUOTE] = HALF_SHORT, False
    begins[NUMBER, [IN_NUMBER, AFTER_JOINED]] = False
    for kind in (OTHER, QUOTE):
        held = [IN_OTHER, FRESH_QUOTE, AFTER_JOINED]
        begins[kind, held] = False
        step[kind, held] = IN_OTHER
    begins[RUN, IN_WHITE] = False
    return step, begins


def _states_before(classes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The state before each character, by a blocked scan over composed transition functions."""
    n = len(classes)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = step.ravel()
    composed = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], blocks, axis=1)
    bases = columns.astype(np.int32) * N_STATES
    for j in range(BLOCK):
        composed = flat[bases[j] + composed]
    state, enter = START, np.empty(blocks, dtype=np.uint8)
    functions = composed.T.tolist()
    for b in range(blocks):
        enter[b] = state
        state = functions[b][state]
    before = np.empty((BLOCK, blocks), dtype=np.uint8)
    for j in range(BLOCK):
        before[j] = enter
        enter = flat[bases[j] + enter]
    return before.T.ravel()[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin among the code points of some texts; ``first`` marks each text's first code point."""
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kinds = _class_table()[points]
    after = np.full(n, WHITE, dtype=np.uint8)
    after[:-1] = kinds[1:]
    after[:-1][first[1:]] = WHITE
    following = np.zeros(n, dtype=np.uint32)
    following[:-1] = points[1:]
    following[:-1][first[1:]] = 0
    classes = kinds.copy()
    classes[((points == 114) | (points == 118)) & (following == 101)] = PAIR
    classes[(points == 108) & (following == 108)] = PAIR
    white = kinds >= SPACE
    solid_next = after < SPACE
    classes[white] = RUN
    classes[white & solid_next & (kinds == SPACE)] = JOINED
    classes[white & solid_next & (kinds == WHITE)] = ALONE
    classes[first] += N_CLASSES
    step, begins = _automaton()
    return np.flatnonzero(begins[classes, _states_before(classes, step)])


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, never = ranks.get, len(ranks) + 1
    cut = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == never:
            break
        i = pairs.index(best)
        del cut[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cut[i] : cut[i + 2]], never)
        if i:
            pairs[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], never)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges from a heap: n log n for very long pieces."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            end = after[after[i]]
            rank = ranks.get(piece[i:end])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        alive[after[i]] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """The vocabulary with a bounded cache of merged pieces."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.cache_pieces = cache_pieces
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(self.cache_pieces + 1, dtype=np.int64)

    def _learn(self, missing: list[bytes]) -> None:
        ranks, ids, ends, at_end = self.ranks, [], [], int(self.begin[len(self.slots)])
        for piece in missing:
            rank = ranks.get(piece)
            if rank is not None:
                ids.append(rank)
            else:
                ids += _merge_short(piece, ranks) if len(piece) < 200 else _merge_long(piece, ranks)
            ends.append(at_end + len(ids))
        while len(self.pool) < at_end + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at_end : at_end + len(ids)] = ids
        known = len(self.slots)
        if known + len(missing) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(missing) + 1, dtype=np.int64)])
        self.begin[known + 1 : known + 1 + len(missing)] = ends
        self.slots.update(zip(missing, range(known, known + len(missing)), strict=True))

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where the ids of each text begin and the last one's end)."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        first = np.zeros(len(points), dtype=bool)
        begin_points = np.searchsorted(lead, ends)
        first[begin_points[:-1][np.diff(ends) > 0]] = True
        starts = lead[piece_starts(points, first)]
        begin_pieces = np.searchsorted(starts, ends)
        data, bounds = raw.tobytes(), [*starts.tolist(), len(raw)]
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        missing = [x for x in dict.fromkeys(pieces) if x not in self.slots]
        if len(self.slots) + len(missing) > self.cache_pieces:
            self._clear()
            missing = list(dict.fromkeys(pieces))
        if missing:
            self._learn(missing)
        slots = np.fromiter(map(self.slots.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        size = self.begin[slots + 1] - self.begin[slots]
        total = np.zeros(len(slots) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        place = np.repeat(self.begin[slots] - total[:-1], size) + np.arange(total[-1])
        return self.pool[place], total[begin_pieces]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset after each token of one text."""
        return np.cumsum(self.sizes[ids])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    if os.path.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Encoder(vocabulary)


def _texts(batch: pa.RecordBatch, vocabulary: str) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row range and the ids of each of its texts, chunk by chunk."""
    coder = encoder(vocabulary)
    for row, stop, raw, ends in at.chunks(batch.column("text")):
        ids, begin = coder.encode(raw, ends)
        yield row, stop, [ids[a:b] for a, b in zip(begin, begin[1:], strict=False)]


def _digests(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            counts, id_hashes, text_hashes = [], [], []
            for _, _, texts in _texts(batch, vocabulary):
                for array in texts:
                    ids = array.tolist()
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(coder.decimal(ids).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            columns = [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return run


def _arrays(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for row, stop, texts in _texts(batch, vocabulary):
                ends = pa.array(np.cumsum([0, *map(len, texts)]).astype(np.int32))
                ids = pa.array(np.concatenate(texts).astype(np.int32))
                places = pa.array(np.concatenate([coder.offsets(x) for x in texts]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, stop - row),
                        pa.ListArray.from_arrays(ends, ids),
                        pa.ListArray.from_arrays(ends, places),
                    ],
                    names=["doc_id", "ids", "ends"],
                )

    return run


def _texts_back(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"]
            )

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, ends): token ids of each text and the byte offset after each token."""
    rows = only(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_arrays(vocabulary), f"doc_id {kind}, ids array<int>, ends array<long>")


def decode(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, decoded): the bytes of each list of ids."""
    rows = only(tokens, doc_id=doc_id, ids=ids)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_texts_back(vocabulary), f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids and hashes both."""
    rows = only(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _digests(vocabulary), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
