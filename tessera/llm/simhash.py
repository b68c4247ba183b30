"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments, so that one of them differs by at most one bit.  It is indexed under a key for each of
its bits: the segment that holds the bit, with that bit left out.  Two fingerprints one of whose segments differs by at most one
bit then share a key; those of a key are brought together by an equality shuffle and verified.

``near_duplicates`` links 64-bit fingerprints of at most four differing bits: of three segments, one has at most one of them, so
no link is missed.  A pair is handed on only at its first shared key and only if the key's links so far don't connect it already,
so a dense group yields links in proportion to its members, not to its pairs.  Keys with very many fingerprints are split into
blocks; a task compares two blocks with each other, or one with itself.

``similar_documents`` links texts whose shingle sets have a Jaccard similarity of at least 0.8.  Such pairs differ by about a
seventh of the bits, so fingerprints have three words of 64 bits, each cut into three segments, and candidates are verified on all bits, then by their
shingles.  Each key first offers neighbours only, which joins large groups; once these are verified, it offers the pairs of
different components, but of a row with many partners under a key only an edge to the first text that it is connected with there.  Such edges make
crowds, in which all pairs of texts are compared by products of matrices; a crowd hands on a forest of its links.  Pairs of one
crowd that other keys offer are left to it.  So what is offered grows with the rows, and no offer is lost.  A pair is missed if none of its segments differs by fewer than two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sieved, slices, spool, spooled
from .components import components

SEED = 42
#: First bits of the three segments, and the end.
SEGMENTS = (0, 22, 43, 64)
#: Largest number of differing bits of a link; the three segments are right for four.
MOST_BITS = 4
#: Fingerprints of one key that a task compares; keys with more are split.
BLOCK = 8192
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Words of 64 bits of the fingerprints of ``similar_documents``, and the width of its shingles.
WORDS, WIDTH = 3, 5
#: Most differing bits of a candidate: in the 32 of another word that travel with a key, and in all.
MOST_IN_CHECK, MOST_IN_ALL = 11, 54
#: Partners of a row under one key beyond which it is left to its crowd.
PARTNERS = 8
#: Texts, and shingles, of a block of a crowd; a task compares two blocks, or one with itself.
CROWD_TEXTS, CROWD_SHINGLES = 2048, 1 << 20
#: Texts of two blocks that must have a shingle for it to be a column of a matrix, and columns of one.
FREQUENT, COLUMNS = 32, 1024


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    words = text.lower().split()  # on bytes: A-Z, and the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return int.from_bytes(xxhash.xxh64_digest(joined, SEED))
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    hashed, digest = [joined[a + 1 : b] for a, b in zip(ends, ends[width:])], xxhash.xxh64_digest
    n, ones = len(hashed), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = np.frombuffer(b"".join([digest(s, SEED) for s in hashed[at : at + CHUNK]]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        made = np.array([fingerprint(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], ["doc_id", "fp"])


def _first_key(x: np.ndarray) -> np.ndarray:
    """For each xor of two fingerprints, the smallest index of a key that both have; 64 if none."""
    out = np.full(len(x), 64, np.int64)
    for lo, hi in reversed(list(zip(SEGMENTS, SEGMENTS[1:]))):
        part = (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        ones = np.bitwise_count(part)
        out[ones == 0] = lo
        single = ones == 1
        out[single] = lo + np.log2(part[single].astype(np.float64)).astype(np.int64)
    return out


def verified_links(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, mine: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key and sub, which stand together.  They connect what all pairs of at most ``most``
    differing bits that have this as their first key would connect.  ``mine`` is a row's block: where sub stands for two
    blocks, only rows of different blocks are compared."""
    two = (sub >> 24) != (sub & (1 << 24) - 1)
    n = len(fp)
    group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])) if n else np.zeros(0, np.int64)
    label, lefts, rights, step = np.arange(n), [], [], 1
    at = np.flatnonzero(group[1:] == group[:-1]) if n else np.zeros(0, np.int64)
    while len(at):
        apart = at[(label[at] != label[at + step]) & ~(two[at] & (mine[at] == mine[at + step]))]
        x = fp[apart] ^ fp[apart + step]
        near = np.bitwise_count(x) <= most
        apart, x = apart[near], x[near]
        own = (_first_key(x) == key[apart] >> 22) & (x != 0)
        a, b = apart[own], apart[own] + step
        if len(a):
            lefts.append(fp[a])
            rights.append(fp[b])
            parent = np.arange(n)
            la, lb = label[a], label[b]
            parent[np.maximum(la, lb)] = np.minimum(la, lb)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
        step += 1
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
    if not lefts:
        return fp[:0], fp[:0]
    return np.concatenate(lefts), np.concatenate(rights)


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns, cut so that rows that agree in the first ``keys`` columns, and stand together, stay together."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        now = [c.to_numpy() for c in b.columns]
        if not len(now[0]):
            continue
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in now[:keys]])) + 1
        if held and any(held[-1][k][-1] != now[k][0] for k in range(keys)):
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if len(new):
            held.append([x[: new[-1]] for x in now])
            yield [np.concatenate(x) for x in zip(*held)]
            held, now = [], [x[new[-1] :] for x in now]
        held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _by_key(batches, 2):
        a, b = verified_links(parts[0], parts[1], parts[2].view(np.uint64), parts[3])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])


def _index(prints: DataFrame) -> DataFrame:
    """64 rows for each fingerprint fp, with its other columns: under each key.  A key is the number of the bit left out, then the
    segment; ``at``, where there are several words, is the number of the word."""
    bit = F.col("bit")
    low = F.when(bit < SEGMENTS[1], SEGMENTS[0]).when(bit < SEGMENTS[2], SEGMENTS[1]).otherwise(SEGMENTS[2])
    part = F.expr("(shiftrightunsigned(fp, lo) & (case when lo = 0 then 4194303L else 2097151L end)) & ~shiftleft(1L, bit - lo)")
    number = (F.col("at") * 64 + bit).cast("long") if "at" in prints.columns else bit.cast("long")
    rest = [c for c in prints.columns if c != "at"]
    return prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).withColumn("lo", low).select((F.shiftleft(number, 22) + part).alias("key"), *rest)


def _parts(prints: DataFrame) -> DataFrame:
    """Three rows for each fingerprint fp, with its other columns, under its whole segments: a key, its first bit and width."""
    number = F.col("at") * 64 if "at" in prints.columns else F.lit(0)
    cuts = [F.struct(F.lit(lo).alias("lo"), F.lit(hi - lo).alias("bits"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("part")) for lo, hi in zip(SEGMENTS, SEGMENTS[1:])]
    cut = prints.select("*", F.explode(F.array(*cuts)).alias("s")).withColumn("first", (number + F.col("s.lo")).cast("long"))
    return cut.select((F.shiftleft("first", 22) + F.col("s.part")).alias("key"), F.col("s.bits").alias("bits"), *(c for c in prints.columns if c != "at"))


def _crowded(prints: DataFrame, block: int) -> DataFrame:
    """Keys that may have more than ``2 * block`` fingerprints, with the number of blocks to split them into."""
    full = _parts(prints).groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    bit = full.select("n", F.shiftrightunsigned("key", 22).alias("first"), F.col("key").bitwiseAND(F.lit((1 << 22) - 1)).alias("part"), F.explode(F.expr("sequence(0, bits - 1)")).alias("b"))
    keys = bit.select(F.expr("shiftleft(first + b, 22) + (part & ~shiftleft(1L, b))").alias("key"), "n")
    return keys.groupBy("key").agg(F.ceil((F.sum("n") + block) / F.lit(block)).cast("int").alias("blocks"))


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Columns u, v: links that connect all fingerprints (distinct, column fp) at most four bits apart."""
    index = _index(prints).withColumn("sub", F.lit(0).cast("long")).withColumn("mine", F.lit(0).cast("long"))
    crowded = spool(_crowded(prints, block))
    if not crowded.isEmpty():
        index = _in_blocks(index.drop("sub", "mine"), crowded, "fp")
    ordered = index.select("key", "sub", "fp", "mine").repartition("key", "sub").sortWithinPartitions("key", "sub")
    return ordered.mapInArrow(_links, "u long, v long")


def _in_blocks(index: DataFrame, crowded: DataFrame, member: str, how: str = "left") -> DataFrame:
    """Rows of a crowded key once for each other block: ``mine`` is the row's block, ``sub`` stands for the pair of blocks."""
    mine, other = F.pmod(F.xxhash64(member), F.col("blocks")), F.col("other")
    split = index.join(crowded, "key", how).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine.cast("long")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return split.withColumn("sub", (F.least("mine", other) * (1 << 24) + F.greatest("mine", other)).cast("long")).drop("blocks", "other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) for every row of ``docs``.

    A null text counts as an empty one; texts without a word have fingerprint zero and are linked like any other.  Ids may
    have any type with an order; a row with a null id gets the component of its fingerprint, and null if no row of the
    component has an id.  Repeated rows are kept.  An empty table gives an empty result.  Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = spool(docs.mapInArrow(_fingerprints, f"doc_id {kind}, fp long"))
    prints = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(spool(near_links(prints.select("fp"), block)))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text, made of their words' hashes; a shorter text is one shingle."""
    words = text.lower().split()  # on bytes: A-Z, and the six white-space bytes
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    made = own[: len(own) - width + 1]
    for k in range(1, width):
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + own[k : k + len(made)]
    return np.unique((made ^ (made >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


_LANES = np.uint64(0x0101010101010101)


def wide_fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of WORDS words for each set of hashes (joined, of the given sizes, none empty): a bit is 1 if over half of the
    set's hashes, mixed anew for each word, have it."""
    starts = np.cumsum(sizes) - sizes
    # Bits are counted in lanes of a byte, eight to a word, so over at most 255 hashes at a time.
    runs = -(-sizes // 255)
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    of_set = np.cumsum(runs) - runs
    out = np.empty((len(sizes), WORDS), np.uint64)
    for w in range(WORDS):
        x = (hashes ^ np.uint64(0xA24BAED4963EE407 * (w + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        word = np.zeros(len(sizes), np.uint64)
        for bit in range(8):
            lanes = np.add.reduceat((x >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes.astype(np.int64), of_set, axis=0)
            word |= ((2 * ones > sizes[:, None]).astype(np.uint64) << (np.arange(0, 64, 8, dtype=np.uint64) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
        out[:, w] = word
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingles(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
        ids = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        words = wide_fingerprints(np.concatenate(sets), np.array([len(h) for h in sets])).view(np.int64) if sets else np.zeros((0, WORDS), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids), b.column(1), *(pa.array(np.ascontiguousarray(words[:, w])) for w in range(WORDS))], ["doc_id", "id", "text", *(f"w{w}" for w in range(WORDS))])


def _near(check: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((check[a] ^ check[b]).view(np.uint64)) <= MOST_IN_CHECK


def neighbours(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows and of the next ones, where they have one key and may be near."""
    a = np.flatnonzero(key[1:] == key[:-1])
    a = a[_near(check, a, a + 1)]
    return a, a + 1


def across(key: np.ndarray, label: np.ndarray, check: np.ndarray, sub: np.ndarray | None = None, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one key (and sub), and of different labels, that may be near; rows stand by key, sub and label.
    Rows are compared from the end of their own label on, so a label's own pairs cost nothing.  Where sub stands for two
    blocks, only rows of different blocks (mine) are compared."""
    n = len(key)
    if not n:
        return
    new = np.concatenate([[True], key[1:] != key[:-1]])
    if sub is not None:
        new[1:] |= sub[1:] != sub[:-1]
        two = (sub >> 24) != (sub & (1 << 24) - 1)
    other = new | np.concatenate([[True], label[1:] != label[:-1]])
    place = np.arange(n)

    def following(marks: np.ndarray) -> np.ndarray:
        at = np.append(np.flatnonzero(marks), n)
        return at[np.searchsorted(at, place, side="right")]

    end, partner = following(new), following(other)
    a = np.flatnonzero(partner < end)
    b = partner[a]
    while len(a):
        good = _near(check, a, b)
        if sub is not None:
            good &= ~(two[a] & (mine[a] == mine[b]))
        yield a[good], b[good]
        b = b + 1
        live = b < end[a]
        a, b = a[live], b[live]


def _pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["u", "v"])


def _offer_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:  # of a pair of neighbours in different batches, another key offers it, or the second round
        key, ids, check = (c.to_numpy() for c in b.columns)
        yield _pairs(ids, *neighbours(key, check))


def offers(key: np.ndarray, label: np.ndarray, check: np.ndarray, sub: np.ndarray | None = None, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The pairs of ``across``, and False; where one of a pair has more than PARTNERS partners, the pair is held back.  Last,
    and with True, an edge to its first row from each row of whatever the pairs held back connect."""
    n = len(key)
    partners = np.zeros(n, np.int64)
    for a, b in across(key, label, check, sub, mine):
        partners += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    many, root = partners > PARTNERS, np.arange(n)
    if not partners.any():
        return
    for a, b in across(key, label, check, sub, mine):
        back = many[a] | many[b]
        yield a[~back], b[~back], False
        a, b = a[back], b[back]
        while (root[a] != root[b]).any():
            parent = np.arange(n)
            x, y = root[a], root[b]
            parent[np.maximum(x, y)[x != y]] = np.minimum(x, y)[x != y]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            root = parent[root]
    moved = np.flatnonzero(root != np.arange(n))
    yield moved, root[moved], True


def _offered_pairs(ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
    for a, b, crowd in found:
        if crowd:  # to the smallest id, so that keys of one crowd agree in most edges
            least = ids.copy()
            np.minimum.at(least, b, ids[a])
            members, hubs = np.concatenate([a, np.unique(b)]), least[np.concatenate([b, np.unique(b)])]
            made = pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(ids[members])], ["u", "v"])
        else:
            made = _pairs(ids, a, b)
        yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.full(made.num_rows, crowd))], _OFFER)


_OFFER, _OFFER_TYPES = ["u", "v", "crowd"], "u long, v long, crowd boolean"


def _offer_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def unpacked() -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(packed >> 32), b.column(1), b.column(2), pa.array(packed & (1 << 32) - 1)], ["key", "label", "id", "check"])

    for key, label, ids, check in _by_key(unpacked(), 1):
        yield from _offered_pairs(ids, offers(key, label, check))


def _offer_across_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, sub, label, ids, check, mine in _by_key(batches, 2):
        yield from _offered_pairs(ids, offers(key, label, check, sub, mine))


def alike(sets: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs of sets (of distinct numbers) of Jaccard similarity 0.8 or more; where there are two blocks, over those across."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    row, values = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    by = np.argsort(values, kind="stable")
    row, values = row[by], values[by]
    number = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    count = np.bincount(number)[number]
    common = np.zeros((n, n), np.float32)  # right above the diagonal
    often = count > FREQUENT
    r, c = row[often], np.unique(number[often], return_inverse=True)[1]
    for at in range(0, int(c.max()) + 1 if len(c) else 0, COLUMNS):
        lo, hi = np.searchsorted(c, (at, at + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[r[lo:hi], c[lo:hi] - at] = 1
        common += m @ m.T
    r, c = row[~often], number[~often]
    for step in range(1, FREQUENT):
        at = np.flatnonzero(c[step:] == c[:-step])
        if not len(at):
            break
        np.add.at(common, (r[at], r[at + step]), 1)
    link = np.zeros((n, n), bool)
    two = block.min() != block.max()
    for k in range(n):
        link[k, k + 1 :] = 5 * common[k, k + 1 :] >= 4 * (sizes[k] + sizes[k + 1 :] - common[k, k + 1 :])
        if two:
            link[k] &= block != block[k]
    link |= link.T
    left, lefts, rights = np.ones(n, bool), [], []
    for k in range(n):
        if not left[k]:
            continue
        left[k], queue = False, [k]
        while queue:
            i = queue.pop()
            met = np.flatnonzero(link[i] & left)
            left[met] = False
            lefts.append(np.full(len(met), i))
            rights.append(met)
            queue.extend(met.tolist())
    return np.concatenate(lefts or [np.zeros(0, np.int64)]), np.concatenate(rights or [np.zeros(0, np.int64)])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by key and sub; those of both equal are compared."""
    held: list[tuple[int, int, np.ndarray]] = []
    last = None

    def found() -> pa.RecordBatch:
        return _pairs(np.array([h[1] for h in held], np.int64), *alike([h[2] for h in held], np.array([h[0] for h in held])))

    for b in batches:
        key, sub, mine, ids = (b.column(k).to_pylist() for k in range(4))
        sets = np.split(b.column(4).flatten().to_numpy(), np.cumsum(b.column(4).value_lengths().to_numpy())[:-1]) if b.num_rows else []
        for now, m, i, x in zip(zip(key, sub), mine, ids, sets):
            if now != last and held:
                yield found()
                held.clear()
            last = now
            held.append((m, i, x.copy()))
    if held:
        yield found()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [shingles(t or b"").view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *found]))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "set"])


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Columns doc_id and component_id (smallest id reachable over pairs of Jaccard similarity 0.8 or more) for every row.

    Shingles are of five words without case of A to Z.  Null texts count as empty, and empty texts as equal.  Repeated rows
    are kept; ids may have any type with an order; rows with null ids get their component's id, null if no row of it has
    one.  An empty table gives an empty result.  Other columns are ignored.  No pair below 0.8 is linked; of those at or
    above it, the README says how many the keys find.
    """
    kind, words = docs.schema[id_col].dataType.simpleString(), [f"w{w}" for w in range(WORDS)]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = spool(docs.mapInArrow(_sets, f"doc_id {kind}, id long, text string, " + ", ".join(f"{w} long" for w in words)))
    one = spool(rows.groupBy("id").agg(F.min("doc_id").alias("least"), *(F.any_value(w).alias(w) for w in words)))
    texts = rows.select("id", "text")

    def by_word(prints: DataFrame, *more: str) -> DataFrame:
        both = [F.struct(F.col(w).alias("fp"), F.col(other).bitwiseAND(F.lit((1 << 32) - 1)).alias("check")) for w, other in zip(words, words[1:] + words[:1])]
        return prints.select("id", *more, F.posexplode(F.array(*both)).alias("at", "s")).select("id", *more, "at", "s.fp", "s.check")

    def sets_of(needed: DataFrame) -> DataFrame:
        kept = sieved(texts, "id", needed, "id")[0].join(needed, "id", "left_semi").groupBy("id").agg(F.any_value("text").alias("text"))
        return spool(kept.mapInArrow(_shingled, "id long, set array<long>"))

    def verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
        since = spooled()
        near = spool(_within(pairs.distinct(), prints, words))
        sets = sets_of(spool(near.select(F.explode(F.array("u", "v")).alias("id")).distinct()))
        both = near.join(sets.select(F.col("id").alias("u"), F.col("set").alias("s")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("t")), "v")
        common = F.size(F.array_intersect("s", "t"))
        found = spool(both.where(5 * common >= 4 * (F.size("s") + F.size("t") - common)).select("u", "v"))
        release(since)
        return found

    def crowds_of(edges: DataFrame) -> DataFrame:
        # A text has an edge for each of its keys, at most.  All but one are put between its hubs, which are few.
        star = spool(edges.groupBy("v").agg(F.min("u").alias("u"), F.collect_set("u").alias("hubs")))
        edges = star.select("u", "v").union(star.select("u", F.explode("hubs").alias("v")).distinct())
        return spool(components(edges).select(F.col("node").alias("id"), F.col("root").alias("key")))

    def compared(members: DataFrame) -> DataFrame:
        since = spooled()
        held = spool(sets_of(members.select("id")).join(members, "id").select("key", "id", "set"))
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CROWD_TEXTS, F.sum(F.size("set")) / CROWD_SHINGLES)).cast("int")
        split = _in_blocks(held, spool(held.groupBy("key").agg(blocks.alias("blocks"))), "id", "inner")
        split = split.select("key", "sub", "mine", "id", "set").repartition("key", "sub").sortWithinPartitions("key", "sub")
        found = spool(split.mapInArrow(_alike, "u long, v long"))
        release(since)
        return found

    whole = _parts(by_word(one)).select("key", "id", "check").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    some = verified(whole.mapInArrow(_offer_neighbours, "u long, v long"), one.withColumn("crowd", F.lit(None).cast("long")))
    roots = components(some)
    labelled = spool(one.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("label"), *words))
    index = _index(by_word(labelled, "label")).select("key", "label", "id", "check")
    crowded = spool(_crowded(by_word(labelled), block))
    if crowded.isEmpty():
        offered = _offered(index)
    else:  # what such a key holds is counted; keys of one label have nothing to offer, the others are split
        held = index.join(crowded, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
        held = spool(held.select("key", F.when(F.col("a") != F.col("b"), F.ceil(F.col("n") / block)).cast("int").alias("blocks")))
        split = _in_blocks(index.join(held, "key").drop("blocks"), held.where("blocks is not null"), "id", "inner")
        split = split.select("key", "sub", "label", "id", "check", "mine").repartition("key", "sub").sortWithinPartitions("key", "sub", "label")
        offered = _offered(index.join(held, "key", "left_anti")).union(split.mapInArrow(_offer_across_blocks, _OFFER_TYPES))
    offered = spool(offered)
    crowds = crowds_of(offered.where("crowd").select("u", "v"))
    marked = spool(one.join(crowds, "id", "left").select("id", *words, F.col("key").alias("crowd")))
    roots = components(some.union(verified(offered.where("not crowd").select("u", "v"), marked)).union(compared(crowds)))
    rooted = one.select("id", "least").join(roots, one.id == roots.node, "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "id").join(rooted.join(least, "root").select("id", "component_id"), "id").select("doc_id", "component_id")


def _offered(index: DataFrame) -> DataFrame:
    """Offers of all keys.  A key has 30 bits, and shares a long with the check: most of the work and disk is this shuffle's."""
    key = F.shiftrightunsigned("packed", 32)
    packed = index.select((F.shiftleft("key", 32) + F.col("check")).alias("packed"), "label", "id")
    return packed.repartition(key).sortWithinPartitions(key, "label").mapInArrow(_offer_across, _OFFER_TYPES)


def _within(pairs: DataFrame, prints: DataFrame, words: list[str]) -> DataFrame:
    """The pairs whose fingerprints differ in at most MOST_IN_ALL bits, but those of one crowd (null: none), where all are compared."""
    left = prints.select(F.col("id").alias("u"), F.col("crowd").alias("u_crowd"), *(F.col(w).alias(f"u_{w}") for w in words))
    right = prints.select(F.col("id").alias("v"), F.col("crowd").alias("v_crowd"), *(F.col(w).alias(f"v_{w}") for w in words))
    apart = sum((F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in words), F.lit(0))
    one_crowd = F.coalesce(F.col("u_crowd") == F.col("v_crowd"), F.lit(False))
    return pairs.join(left, "u").join(right, "v").where((apart <= MOST_IN_ALL) & ~one_crowd).select("u", "v")
