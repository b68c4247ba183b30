"""Removal of byte strings that occur earlier, by suffix arrays over shards of the corpus.

One suffix array of a corpus can't be spread over tasks, so places that may repeat are brought together first.

1. In each 100-byte window, the substring of ``ANCHOR`` bytes with the smallest hash is the window's anchor.  Equal windows
   have equal anchors at equal offsets.  The windows of one anchor are neighbours; together they are its context.  Equal
   contexts are merged inside each batch, then by a shuffle: all but the earliest are removed.  Anchors left with one
   context repeat nowhere else.  The windows of a context that hold the anchor at nearly the same offset have most of their
   bytes in common, its core there; equal windows have equal cores.  So of a context, only windows over a core that another
   context of the anchor has as well may repeat, and a common line among differing neighbours is no work.
2. These windows of the contexts are fetched from the texts and dealt into shards by anchor.  Anchors with very many contexts
   are split into single windows, keyed by their bytes, and merged in each batch again, so that no shard grows with the corpus.
3. Each shard of about one megabyte gets a suffix array by induced sorting and its permuted common prefixes.  A run of
   suffixes that share 100 bytes is one repeated string; all windows of it but the earliest are removed.

Windows are judged on the input.  A last pass joins the removed intervals to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spool
from .suffix_array import permuted_lcp, suffix_array

#: Bytes of an anchor.
ANCHOR = 32
#: Window starts of one piece of a long text, and bytes that are hashed at once.
PIECE = 1 << 17
#: Contexts of one anchor beyond which it is split into windows.
CROWD = 3000
#: Bytes of a shard.
SHARD = 1 << 20
#: Cores of a context, at most, and bits of a core's hash.
CORES, CORE_BITS = 4, 21
#: Contexts of one anchor that are held to compare their cores; if there are more, all their windows are fetched.
HELD = 1 << 18
#: Stands for a null id inside.
NO_ID = -(1 << 63)

_PLACE = np.uint64((1 << 24) - 1)


def _byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_CODES = _byte_codes()
_BASE = 0x2545F4914F6CDD1D


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each substring of ``width`` bytes, built from powers of two."""
    part, size, done, out = _CODES[data], 1, 0, None
    while True:
        if width & size:
            out = part.copy() if out is None else out[: len(part) - done] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + len(out[: len(part) - done])]
            done += size
        if done == width:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    out = out[: len(data) - width + 1]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _offsets(size: int) -> list[tuple[int, int]]:
    """The offsets of an anchor in its windows, first and last, core by core."""
    count = size - ANCHOR + 1
    step = -(-count // CORES)
    return [(lo, min(lo + step, count) - 1) for lo in range(0, count, step)]


@cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


def _cores(data: np.ndarray, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the cores of contexts whose windows hold the anchor at offsets from least to most; zero where there is none."""
    n = 1 << int(len(data)).bit_length()
    upto = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[data] * _powers(n, pow(_BASE, -1, 1 << 64))[: len(data)], dtype=np.uint64)])
    out = []
    for lo, hi in _offsets(size):
        has = (most >= lo) & (least <= hi)
        at = np.where(has, anchor - lo, 0)
        x = (upto[np.where(has, anchor - hi + size, 0)] - upto[at]) * _powers(n, _BASE)[at]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append((x >> np.uint64(64 - CORE_BITS)).astype(np.int64))
    return out


def contexts(pieces: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, ...]:
    """Contexts of the anchors of all windows in pieces (id, place of its first byte, bytes): the arrays anchor hash,
    context hash, id, start, span and cores, as in rows."""
    pieces = [p for p in pieces if len(p[2]) >= size]
    if not pieces:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e, e
    joined = b"".join(p[2] for p in pieces)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    begins = np.concatenate([[0], ends[:-1]])
    hashed = _rolling(data, ANCHOR)
    marked = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
    place = (_sliding_least(marked, size - ANCHOR + 1) & _PLACE).astype(np.int64)
    for e in ends[:-1]:
        place[e - size + 1 : e] = -1  # windows that would leave the piece
    cut = np.flatnonzero(np.diff(place)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
    anchor = place[first]
    kept = anchor >= 0
    first, last, anchor = first[kept], last[kept] + size - 1, anchor[kept]
    piece = np.searchsorted(ends, first, side="right")
    digest = xxhash.xxh3_64_intdigest
    whole = np.array([digest(joined[a:b]) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
    ids, bases = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    most, n = anchor - first, last - first
    cores = [*_cores(data, anchor, most - n + size, most, size), *[np.zeros(len(n), np.int64)] * CORES][:CORES]
    span = (cores[0] << 24) + (n << 8) + most
    return hashed[anchor], whole, ids[piece], first - begins[piece] + bases[piece], span, sum(c << CORE_BITS * k for k, c in enumerate(cores[1:]))


def _pieces(ids: list[int], texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    held, n = [], 0
    for i, text in zip(ids, texts):
        for at in range(0, max(1, len(text) - size + 1), PIECE):
            held.append((i, at, text[at : at + PIECE + size - 1] if len(text) > PIECE else text))
            n += len(held[-1][2])
            if n >= PIECE:
                yield held
                held, n = [], 0
    yield held


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, where they meet or overlap made one."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((end, start, doc))
    doc, start, end = doc[by], start[by], end[by]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    reach = end.copy()
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(doc))):
        np.maximum.accumulate(end[a:b], out=reach[a:b])
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _batch(names: list[str], *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


#: span: hash of the first core, bytes (16 bits) and largest offset of the anchor (8); -1 - bytes: to be removed.  cores: hashes of the others.
_ROW = ["anchor", "context", "doc", "start", "span", "cores"]


def _scan(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            parts = [np.concatenate(x) for x in zip(*(contexts(p, size) for p in _pieces(ids, texts, size)))]
            by = np.lexsort((parts[3], parts[2], parts[1], parts[0]))
            anchor, context, doc, start, span, cores = (x[by] for x in parts)
            n = span >> 8 & 0xFFFF
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])[: len(by)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
            gone = (doc != doc[first]) | (start != start[first])
            yield _batch(_ROW, *(x[new] for x in (anchor, context, doc, start, span, cores)))
            d, s, e = _merged(doc[gone], start[gone], start[gone] + n[gone])
            where = np.array([xxhash.xxh3_64_intdigest(x) for x in np.stack([d, s], 1)], np.uint64) if len(d) else d
            yield _batch(_ROW, where, where, d, s, s - e - 1, np.zeros(len(d), np.int64))

    return run


_FOUND = ["kind", "anchor", "doc", "start", "span"]  # kind 0: remove span bytes; 1: compare these windows, span: bytes * 256 + offset


def _asked(rows: list[np.ndarray], every: np.ndarray, size: int) -> pa.RecordBatch:
    """Of distinct contexts, ordered by anchor, the windows over cores that another of the anchor has; of rows in every, all."""
    anchor, _, doc, start, span, cores = rows
    beside = anchor[1:] == anchor[:-1]
    some = np.concatenate([beside, [False]]) | np.concatenate([[False], beside]) | every if len(anchor) else every
    anchor, doc, start, span, cores, every = (x[some] for x in (anchor, doc, start, span, cores, every))
    most = span & 0xFF
    least = most - (span >> 8 & 0xFFFF) + size
    first, last = np.full(len(most), 1 << 8), np.full(len(most), -1)
    for k, (lo, hi) in enumerate(_offsets(size)):
        has = np.flatnonzero((most >= lo) & (least <= hi))
        core = span[has] >> 24 if not k else cores[has] >> CORE_BITS * (k - 1) & (1 << CORE_BITS) - 1
        by = np.lexsort((core, anchor[has]))
        has, core = has[by], core[by]
        same = (anchor[has[1:]] == anchor[has[:-1]]) & (core[1:] == core[:-1])
        shared = has[np.append(same, False)[: len(has)] | np.append(False, same)[: len(has)] | every[has]]
        first[shared] = np.minimum(first[shared], np.maximum(lo, least[shared]))
        last[shared] = np.maximum(last[shared], np.minimum(hi, most[shared]))
    on = last >= 0
    start, span = start + most - last, (last - first + size) * 256 + last
    return _batch(_FOUND, np.ones(on.sum(), np.int64), anchor[on], doc[on], start[on], span[on])


def _compare(size: int, most: int = HELD) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by anchor, context, doc, start.  Between batches, the distinct contexts of the last anchor are held, or
        if these are too many, only the last one of them, already asked for."""
        held, full = None, False
        for b in batches:
            now = [b.column(k).to_numpy() for k in range(6)]
            gone = now[4] < 0
            yield _batch(_FOUND, np.zeros(gone.sum(), np.int64), now[0][gone], now[2][gone], now[3][gone], -1 - now[4][gone])
            now = [x[~gone] for x in now]
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            anchor, context, doc, start, span, _ = now
            if not len(anchor):
                continue
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = (doc != doc[first]) | (start != start[first])
            yield _batch(_FOUND, np.zeros(gone.sum(), np.int64), anchor[gone], doc[gone], start[gone], span[gone] >> 8 & 0xFFFF)
            now = [x[new] for x in now]
            last, every = now[0] == now[0][-1], (now[0] == now[0][0]) & full
            skip = int(full)
            full = bool(every[-1]) or last.sum() > most
            out = np.ones(len(last), bool) if full else ~last
            if full:
                every |= last
            yield _asked([x[out][skip:] for x in now], every[out][skip:], size)
            held = [x[-1:] if full else x[last] for x in now]
        if held is not None and not full:
            yield _asked(held, np.zeros(len(held[0]), bool), size)

    return run


_SHARD_ROW = ["shard_key", "doc", "start", "span", "bytes"]  # bytes null: remove span bytes


def _fetch(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: list[tuple[int, int, int, int, bytes | None]] = []
            seen: dict[bytes, tuple[int, int]] = {}
            for doc, text, asked in sorted(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()), key=lambda r: (r[0], r[1])):
                for x in sorted(asked, key=lambda x: x["start"]):
                    start, n = x["start"], x["span"] >> 8
                    if not x["crowded"]:
                        rows.append((x["anchor"], doc, start, n, text[start : start + n]))
                        continue
                    for at in range(start, start + n - size + 1):
                        some = text[at : at + size]
                        key = xxhash.xxh3_64_intdigest(some, x["anchor"] & (1 << 64) - 1)
                        key -= (key >> 63) << 64
                        if seen.setdefault(some, (doc, at)) == (doc, at):
                            rows.append((key, doc, at, size, some))
                        else:
                            rows.append((key, doc, at, size, None))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.binary())], _SHARD_ROW)

    return run


def repeated(rows: list[tuple[int, int, bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (id, start, end) of the windows in a shard's contexts (id, start, bytes) that occur earlier in it."""
    if not rows:
        e = np.zeros(0, np.int64)
        return e, e, e
    text = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    n = np.array([len(r[2]) for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    sa = suffix_array(text)
    run = np.cumsum(permuted_lcp(text, sa)[sa] < size)
    whole = (inside + size <= n[row])[sa]
    sa, run = sa[whole], run[whole]
    doc = np.array([r[0] for r in rows], np.int64)[row[sa]]
    start = np.array([r[1] for r in rows], np.int64)[row[sa]] + inside[sa]
    by = np.lexsort((start, doc, run))
    doc, start, run = doc[by], start[by], run[by]
    new = np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0)) if len(run) else by
    gone = (doc != doc[first]) | (start != start[first])
    return _merged(doc[gone], start[gone], start[gone] + size)


_GONE = ["doc", "start", "end"]


def _shards(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        n, last = 0, None
        for b in batches:
            key, doc, start, span, some = (c.to_pylist() for c in b.columns)
            gone = [k for k, x in enumerate(some) if x is None]
            yield _batch(_GONE, *(np.array(x, np.int64) for x in ([doc[k] for k in gone], [start[k] for k in gone], [start[k] + span[k] for k in gone])))
            for k, x in enumerate(some):
                if x is None:
                    continue
                if key[k] != last and n >= SHARD:
                    yield _batch(_GONE, *repeated(held, size))
                    held, n = [], 0
                held.append((doc[k], start[k], x))
                n, last = n + len(x), key[k]
        yield _batch(_GONE, *repeated(held, size))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out, as_text = [], _TEXT in b.schema.names
        for text, gone in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
            at, kept, runs, removed, n = 0, [], 0, 0, len(text)
            open_end = -1
            for start, end in sorted((g["start"], g["end"]) for g in gone or ()):
                if end <= open_end:
                    continue
                if start > open_end:
                    runs += 1
                    kept.append(text[at:start])
                else:
                    start = open_end
                removed, at, open_end = removed + end - start, end, end
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((n, removed, runs, hashlib.sha256(left).hexdigest(), left, left.decode("utf-8", "ignore") if as_text else None))
        cols = list(zip(*out)) or [()] * 6
        made = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())]
        if as_text:
            made.append(pa.array(cols[5], pa.string()))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"][: len(made)]
        rest = [k for k in range(2, b.num_columns) if b.schema.names[k] != _TEXT]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), *made], [*(b.schema.names[k] for k in rest), *names])


#: A column that asks _cut for the rest as text as well.
_TEXT = "_as_text"


def _texts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Columns doc (a long for each row, in the order that earlier is judged by), text, doc_id and those to carry.

    Where ids are unique, they are the longs themselves.  Otherwise the rows are put in the order of ids, null first, and of
    a hash of their texts, and numbered, which the shared folder keeps."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carry)
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    placed = rows.withColumn("_by", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("_by"), F.asc("_tie")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "_by", "_tie")
    return spool(placed.drop("_by", "_tie").withColumn("doc", F.monotonically_increasing_id()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) for every row of ``docs``.

    A byte goes if a string of ``size`` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
    the same one.  A null text counts as empty; shorter texts stay whole.  Ids are integers; a null id is smaller than all
    others.  Each row is a document of its own, also where ids are repeated or null: rows of one id come in the order of a
    hash of their texts.  An empty table gives an empty result.  The columns of ``carry`` come through as they are, and with
    them kept_text, the rest without bytes that make no character; other columns are ignored.
    """
    if not ANCHOR < size < 256 - ANCHOR:
        raise ValueError(f"size must be between {ANCHOR + 1} and {255 - ANCHOR}")
    texts = _texts(docs, id_col, text_col, carry)
    types = ", ".join(f"{c} long" for c in _ROW)
    placed = texts.select("doc", "text").mapInArrow(_scan(size), types).repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "start")
    found = spool(placed.mapInArrow(_compare(size), ", ".join(f"{c} long" for c in _FOUND)))
    asked = found.where("kind = 1").drop("kind")
    crowds = asked.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("anchor", F.lit(True).alias("crowded"))
    asked = asked.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    of_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "span", "crowded")).alias("asked"))
    fetched = texts.select("doc", "text").join(of_doc, "doc").select("doc", "text", "asked").mapInArrow(_fetch(size), "shard_key long, doc long, start long, span long, bytes binary")
    by_suffix = fetched.repartition("shard_key").sortWithinPartitions("shard_key", "doc", "start").mapInArrow(_shards(size), "doc long, start long, end long")
    gone = found.where("kind = 0").select("doc", "start", (F.col("start") + F.col("span")).alias("end")).union(by_suffix)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    cut = texts.join(gone, "doc", "left").select("text", "gone", "doc_id", *carry, *([F.lit(True).alias(_TEXT)] if carry else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[2:] if f.name != _TEXT)
    return cut.mapInArrow(_cut, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + (", kept_text string" if carry else ""))
