"""Variable-capacity best-fit packing of sequences.

Best-fit decreasing looks at lengths only, and no piece is longer than the largest permitted capacity.  So the histogram of
piece lengths, which that capacity bounds, is packed on the driver: bins with the same contents are filled together, with a
count.  Pieces are then numbered within their length, without gaps, and the numbers say which bin takes a piece.

A new bin gets the permitted capacity of least expected cost for a sequence token, ``(fixed + capacity) / filled``, given how
much of the remaining lengths could fill it; in the end each bin is downsized to the smallest permitted capacity that holds
its contents.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless, spool

#: Permitted capacities, in tokens.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Tokens that opening a bin costs.
FIXED_COST = 16


#: (capacity, number of such bins, ((length, pieces in each), ...))
Bins = list[tuple[int, int, tuple[tuple[int, int], ...]]]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, fixed: int = FIXED_COST) -> Bins:
    """The cheapest of the packings that open bins of any permitted capacity from some smallest one up."""
    sizes = sorted(set(capacities))
    tried = [fill(histogram, sizes, sizes[k:], fixed) for k in range(len(sizes))]
    return min(tried, key=lambda bins: sum((fixed + capacity) * n for capacity, n, _ in bins))


def fill(histogram: dict[int, int], sizes: list[int], opening: list[int], fixed: int) -> Bins:
    """Decreasing best fit, with bins of the capacities in ``opening`` that are in the end downsized to one of ``sizes``.

    The longest piece left goes to the open bin with the least room that holds it; if none does, it opens
    a bin.  Open bins are kept by their room, equal ones with a count.  A bin that a piece fits best is still the best for the
    next piece of that length if there is room, so the pieces of a length go to equal bins at once; the last such bins, if
    the pieces run short, are told apart.
    """
    lengths = sorted((k for k, n in histogram.items() if n > 0), reverse=True)
    total = sum(k * histogram[k] for k in lengths)
    smallest = lengths[-1] if lengths else 0
    rooms: list[int] = []  # ascending; for each, its bins as [number, capacity, contents]
    open_bins: dict[int, list[list]] = {}

    def add(room: int, bins: int, capacity: int, held: tuple) -> None:
        if bins:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append([bins, capacity, held])

    def cheapest(length: int) -> int:
        """Of the capacities that hold the length, the one of least cost for a token that it can hope to hold."""

        def cost(c: int) -> float:
            filled = length
            if c - length >= smallest:
                filled += min(c - length - (smallest - 1) // 2, total - length)
            return (fixed + c) / max(1, filled)

        return min((c for c in opening if c >= length), key=lambda c: (cost(c), c))

    for length in lengths:
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, capacity, held = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                capacity = room = cheapest(length)
                bins, held = -(-left // (room // length)), ()
            each = room // length
            whole = min(bins, left // each)
            rest = left - whole * each if whole < bins else 0
            add(room - each * length, whole, capacity, (*held, (length, each)))
            if rest:
                add(room - rest * length, 1, capacity, (*held, (length, rest)))
            add(room, bins - whole - (rest > 0), capacity, held)
            left -= whole * each + rest
            total -= length * (whole * each + rest)
    classes = [(capacity, bins, held) for room in rooms for bins, capacity, held in open_bins[room]]
    return [(next(c for c in sizes if c >= sum(k * n for k, n in held)), bins, held) for _, bins, held in classes]


def word_count(text: Column) -> Column:
    """Tokens of a text: its words, and one for its end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", length: Column | None = None, fixed: int = FIXED_COST) -> DataFrame:
    """Columns doc_id, piece, first_token, n_tokens, bin_id, bin_capacity, bin_offset: each document's pieces in order.

    ``length`` gives a row's tokens (words of ``text`` and one, if not given); null or less than one counts as one.  A document
    longer than the largest capacity is cut into full pieces and a rest; no token is dropped.  Rows with null ids and repeated
    rows are packed like any other.  An empty table gives an empty result.  Other columns are ignored.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most, spark = max(capacities), docs.sparkSession
    tokens = word_count(F.col("text")) if length is None else length
    sized = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long").alias("all"))
    pieces = spool(
        sized.select("doc_id", "all", F.explode(F.expr(f"sequence(0L, (all - 1) div {most}L)")).alias("piece")).select(
            "doc_id", "piece", F.monotonically_increasing_id().alias("row"), (F.col("piece") * most).alias("first_token"), F.least(F.lit(most), F.col("all") - F.col("piece") * most).cast("int").alias("n_tokens")
        )
    )
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max(capacities) rows
    rows, used, opened = [], dict.fromkeys(histogram, 0), 0
    for capacity, bins, held in plan(histogram, capacities, fixed):
        offset = 0
        for k, n in held:
            rows.append((k, used[k], used[k] + n * bins, n, opened, capacity, offset))
            used[k] += n * bins
            offset += k * n
        opened += bins
    runs = T.StructType()
    for name in ("n_tokens", "low", "high", "each", "opened", "bin_capacity", "offset"):
        runs = runs.add(name, T.IntegerType() if name in ("n_tokens", "bin_capacity") else T.LongType())
    numbered = gapless(pieces, ["n_tokens"], ["doc_id", "piece", "row"], "number", max(histogram.values(), default=0))
    # For each length, its runs in order; a piece finds its own by its number.  The plan's rows don't depend on the corpus' size.
    of_length = spark.createDataFrame(rows, runs).groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("high", "low", "each", "opened", "bin_capacity", "offset"))).alias("runs"))
    run = F.element_at(F.filter("runs", lambda r: r["high"] > F.col("number")), 1)
    found = numbered.join(F.broadcast(of_length), "n_tokens").withColumn("run", run)
    inside = F.col("number") - F.col("run.low")
    return found.select(
        "doc_id", "piece", "first_token", "n_tokens",
        (F.col("run.opened") + F.floor(inside / F.col("run.each"))).cast("long").alias("bin_id"),
        F.col("run.bin_capacity").alias("bin_capacity"),
        (F.col("run.offset") + F.pmod(inside, F.col("run.each")) * F.col("n_tokens")).cast("long").alias("bin_offset"),
    )
