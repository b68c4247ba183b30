"""Byte-level BPE: pre-tokenisation by scans over codepoint classes, cached pair merging, decoding by offsets.

Every codepoint gets a class, which also says what follows it where a rule looks ahead.  A small automaton reads the classes
and says before which codepoint a piece begins.  Its transition functions compose associatively: the text is laid out in
columns, the functions of all columns are composed step by step for every state at once, the columns' functions are scanned
by doubling, and a last pass from the now known states marks the boundaries.  No regular expression is used.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Classes: letter, number, other, apostrophe before a contraction of one or of two letters, space that joins what follows,
# other white space before something else, white space before white space or the end, end of a text.
_L, _N, _O, _Q1, _Q2, _JOIN, _LONE, _SPACE, _END = range(9)
# States: what was read last.
_START, _IN_L, _IN_N, _IN_O, _JOINED, _IN_SPACE, _WANT1, _WANT2 = range(8)
_STATES = 8
#: Steps of a column; codepoints scanned at once.
_STEPS = 256
_CHUNK = 1 << 18
#: Pieces that a worker remembers before it starts another generation; the last one is kept besides.
REMEMBERED = 150_000
#: Texts are learned in groups of about so many bytes, which bounds what is remembered besides.
_LEARN = 1 << 21
#: Pieces merged at once; the bytes of them must number less than 2 ** 24.
_AT_ONCE = 1 << 16
_NEVER = (1 << 31) - 1
_SPREAD = np.int64(0x1E3779B97F4A7C15)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by class and state."""
    to, begins = np.zeros((9, _STATES), np.uint8), np.ones((9, _STATES), bool)
    for kind, own in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O)):
        to[kind] = own
        begins[kind, [own, _JOINED]] = False
    to[_L, _WANT1], begins[_L, _WANT1] = _START, False
    to[_L, _WANT2], begins[_L, _WANT2] = _WANT1, False
    for kind, want in ((_Q1, _WANT1), (_Q2, _WANT2)):
        to[kind] = want
        for s in (_IN_O, _JOINED):
            to[kind, s], begins[kind, s] = _IN_O, False
    to[_JOIN] = _JOINED
    to[_LONE] = _START
    to[_SPACE] = _IN_SPACE
    begins[_SPACE, _IN_SPACE] = False
    to[_END] = _START
    return to, begins


_TO, _BEGINS = _automaton()
_TO_FLAT, _BEGINS_FLAT = _TO.reshape(-1), _BEGINS.reshape(-1)
#: Codepoints of White_Space.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    """The plain class of each codepoint."""
    by_letter = {"L": _L, "N": _N}
    out = np.array([by_letter.get(unicodedata.category(chr(c))[0], _O) for c in range(0x110000)], np.uint8)
    out[_BLANKS] = _SPACE
    return out


def classify(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of joined texts; ``ends`` are the places of the separators behind each."""
    kind = _classes()[points]
    kind[ends] = _END
    solid = kind[1:] < _SPACE
    blank = kind[:-1] == _SPACE
    last = np.flatnonzero(blank & solid)
    kind[last] = np.where(points[last] == 32, _JOIN, _LONE)
    at = np.flatnonzero(points == 39)
    padded = np.append(points, np.zeros(2, points.dtype))
    one, two = padded[at + 1], padded[at + 2]
    kind[at[np.isin(one, [ord(c) for c in "stmd"])]] = _Q1
    kind[at[np.isin(one.astype(np.int64) << 21 | two, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = _Q2
    return kind


def boundaries(kind: np.ndarray) -> np.ndarray:
    """For each codepoint, whether a piece begins there.  The first state is that of a text's start."""
    n = len(kind)
    columns = max(1, -(-n // _STEPS))
    laid = np.full(columns * _STEPS, _END, np.uint8)
    laid[:n] = kind
    base = np.ascontiguousarray(laid.reshape(columns, _STEPS).T) * np.uint8(_STATES)
    function = np.tile(np.arange(_STATES, dtype=np.uint8)[:, None], (1, columns))  # state after, by state before and column
    alive = True
    for step in range(_STEPS):
        if alive:
            function = _TO_FLAT[base[step] + function]
            alive = step % 16 or (function != function[0]).any()
        else:  # all states agree in every column, and will from here on
            function[0] = _TO_FLAT[base[step] + function[0]]
    if not alive:
        function[:] = function[0]
    shift = 1
    while shift < columns:  # inclusive scan: compose with the function of the columns before
        composed = np.take_along_axis(function[:, shift:], function[:, :-shift].astype(np.int64), axis=0)
        function = np.concatenate([function[:, :shift], composed], axis=1)
        shift *= 2
    state = np.concatenate([[_START], function[_START, :-1]]).astype(np.uint8)
    out = np.empty((_STEPS, columns), bool)
    for step in range(_STEPS):
        at = base[step] + state
        out[step] = _BEGINS_FLAT[at]
        state = _TO_FLAT[at]
    return out.T.reshape(-1)[:n]


def pieces(texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
    """The UTF-8 bytes of each text and the byte offsets of its pieces, with the end."""
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size >= _CHUNK or k == len(texts) - 1:
            joined = "\0".join(held) + "\0"
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum([len(t) + 1 for t in held]) - 1
            at = np.flatnonzero(boundaries(classify(points, ends)))
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            offset = np.concatenate([[0], np.cumsum(width)])
            data, where = joined.encode("utf-8", "surrogatepass"), offset[at]
            cut = np.searchsorted(at, ends)  # the separators themselves begin pieces
            low = 0
            for end, c in zip(ends.tolist(), cut.tolist()):
                mine = where[low : c + 1]
                first = int(mine[0]) if len(mine) else 0
                yield data[first : int(offset[end])], (mine - first).tolist()
                low = c + 1
            held, size = [], 0


class Coder:
    """Encodes and decodes by a file of ranks: lines of a token in base64 and its rank."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.remembered = remembered
        self.new: dict[bytes, tuple[tuple[int, ...], str]] = {}
        self.old: dict[bytes, tuple[tuple[int, ...], str]] = {}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        self._pair_table()

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece, with a heap of pairs and a linked list."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                k = after[i]
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return tuple([ranks[piece[i : end[i]]] for i in range(n) if end[i]])

    def merge_all(self, some: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many distinct pieces at once: in each round, every piece joins its pair of lowest rank, the leftmost."""
        ranks, out = self.ranks, [()] * len(some)
        short = []
        for k, piece in enumerate(some):
            whole = ranks.get(piece)
            if whole is not None:
                out[k] = (whole,)
            elif len(piece) > 48:
                out[k] = self._merged_long(piece)
            else:
                short.append(k)
        for at in range(0, len(short), _AT_ONCE):
            own = short[at : at + _AT_ONCE]
            for k, ids in zip(own, self._merge_short([some[k] for k in own])):
                out[k] = ids
        return out

    def _merge_short(self, some: list[bytes]) -> list[tuple[int, ...]]:
        n = len(some)
        sizes = np.array([len(p) for p in some])
        token = self.single[np.frombuffer(b"".join(some), np.uint8)]
        owner = np.repeat(np.arange(n), sizes)
        done_owner, done_token = [], []
        while len(token):
            joins = np.full(len(token), _NEVER, np.int64)
            joins[:-1] = self._pair_ranks(token[:-1], token[1:])
            joins[:-1][owner[:-1] != owner[1:]] = _NEVER
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # rank, then place: the least of a piece is its leftmost pair of lowest rank
            least = np.minimum.reduceat((joins << 24) | np.arange(len(token)), first)
            open_ = least >> 24 < _NEVER
            if not open_.all():
                stays = np.repeat(~open_, np.diff(np.append(first, len(token))))
                done_owner.append(owner[stays])
                done_token.append(token[stays])
            at = least[open_] & (1 << 24) - 1
            token[at] = least[open_] >> 24
            keep = np.repeat(open_, np.diff(np.append(first, len(token))))
            keep[at + 1] = False
            token, owner = token[keep], owner[keep]
        owner, token = np.concatenate(done_owner), np.concatenate(done_token)
        token = token[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        return [tuple(token[a:b]) for a, b in zip([0, *ends], ends)]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, or _NEVER, from a table hashed by both ids with linear probing."""
        key = a << 24 | b
        slot = (key * _SPREAD >> 20) & self.mask
        out = np.full(len(key), _NEVER, np.int64)
        found = self.table_key[slot]
        hit = found == key
        out[hit] = self.table_rank[slot[hit]]
        live = np.flatnonzero(~hit & (found >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            found = self.table_key[slot[live]]
            hit = found == key[live]
            out[live[hit]] = self.table_rank[slot[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out

    def _pair_table(self) -> None:
        """Every split of a token into two tokens, with the token's rank."""
        ranks = self.ranks
        pairs = [(left << 24 | right, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask = size - 1
        self.table_key, self.table_rank = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        key, rank = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        slot = (key * _SPREAD >> 20) & self.mask
        for s, k, r in zip(slot.tolist(), key.tolist(), rank.tolist()):
            while self.table_key[s] >= 0:
                s = (s + 1) & self.mask
            self.table_key[s], self.table_rank[s] = k, r

    def learn(self, texts: list[tuple[bytes, list[int]]]) -> None:
        """Merges the pieces of a batch that aren't remembered, and remembers all of the batch's short ones."""
        if len(self.new) >= self.remembered:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = {data[a:b] for data, offsets in texts for a, b in zip(offsets, offsets[1:])}
        missing.difference_update(new)
        for piece in missing & old.keys():
            new[piece] = old[piece]
            missing.discard(piece)
        some = list(missing)
        for piece, ids in zip(some, self.merge_all(some)):
            new[piece] = ids, ",".join(map(str, ids))

    def encode(self, data: bytes, offsets: list[int]) -> tuple[np.ndarray, str]:
        """The ids of a text cut at offsets, also as decimals joined by commas.  Its pieces must have been learned."""
        get = self.new.__getitem__
        found = [get(data[a:b]) for a, b in zip(offsets, offsets[1:])]
        return np.fromiter(chain.from_iterable([f[0] for f in found]), np.int64), ",".join([f[1] for f in found])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the vocabulary by offsets."""
        n = self.length[ids]
        upto = np.cumsum(n)
        where = np.arange(upto[-1] if len(n) else 0) + np.repeat(self.start[ids] - (upto - n), n)
        return self.bytes[where].tobytes()


@lru_cache(4)
def coder(path: str) -> Coder:
    """One coder for each file and worker; what it remembers lasts from task to task."""
    return Coder(path)


def encoded(own: Coder, texts: list[str]) -> Iterator[tuple[bytes, list[int], np.ndarray, str]]:
    """For each text its bytes, the offsets of its pieces, its ids, and these as decimals."""
    held: list[tuple[bytes, list[int]]] = []
    size = 0
    for cut in chain(pieces(texts), [None]):
        if cut is not None:
            held.append(cut)
            size += len(cut[0])
        if held and (cut is None or size >= _LEARN):
            own.learn(held)
            for data, offsets in held:
                yield data, offsets, *own.encode(data, offsets)
            held, size = [], 0


def encode_texts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked) for every row of ``docs``.

    A null text counts as empty: no ids, and the digests of nothing.  Repeated rows and null ids are kept; an empty table
    gives an empty result; other columns are ignored.  ``ranks_path`` must name a file on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path)
        for b in slices(batches):
            out = []
            for data, offsets, ids, said in encoded(own, [t or "" for t in b.column(1).to_pylist()]):
                decoded = own.decode(ids)
                out.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids.tolist() if with_ids else None))
            cols = list(zip(*out)) or [()] * 4
            made = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(cols[3], pa.list_(pa.int64()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else ""))
