"""Holding a coarse tile while finer ones arrive, and reading through a cache that is checked for freshness, as folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import Machine


def may_hold(in_view: Column, ready: Column, sse: Column, finer: Column, most_sse: float = 16.0, factor: float = 3.0) -> Column:
    """Whether a tile may stand for its unfinished children: seen, ready, of a known error that isn't too large, and with a
    finer piece there."""
    return F.coalesce(in_view & ready & finer & (sse > 0) & (sse <= most_sse * factor), F.lit(False))


def hold_clock(most_frames: int = 45, cooldown: int = 600) -> Machine:
    """The clock of a tile's holds over its frames.

    A frame may ``candidate`` for a hold, or have ``advanced`` to all finer tiles, after which none is held for ``cooldown`` frames
    (0: never again).  A gap of frames begins a new episode; one of ``most_frames`` ends holding for good.
    """
    cool = "(a.advanced_at > 0)" if cooldown == 0 else f"(a.advanced_at > 0 AND b.frame - a.advanced_at < {cooldown})"
    asks = f"(b.candidate AND NOT b.advanced AND a.expired = 0 AND NOT {cool})"
    start = "CASE WHEN a.prev = b.frame - 1 THEN a.start ELSE b.frame END"
    ends = f"({asks} AND b.frame - {start} >= {most_frames})"
    return Machine(
        fields=(
            ("start", "BIGINT", "0", f"CASE WHEN {asks} THEN {start} ELSE a.start END"),
            ("prev", "BIGINT", "-1", f"CASE WHEN {asks} THEN b.frame ELSE a.prev END"),
            ("advanced_at", "BIGINT", "0", "CASE WHEN b.advanced THEN b.frame ELSE a.advanced_at END"),
            ("expired", "BIGINT", "0", f"CASE WHEN {ends} THEN 1 ELSE a.expired END"),
            ("held", "BIGINT", "0", f"a.held + CASE WHEN {asks} AND NOT {ends} THEN 1 ELSE 0 END"),
            ("episodes", "BIGINT", "0", f"a.episodes + CASE WHEN {asks} AND a.prev <> b.frame - 1 THEN 1 ELSE 0 END"),
        ),
        inputs=(("frame", "BIGINT"), ("candidate", "BOOLEAN"), ("advanced", "BOOLEAN")),
    )


_FRESH = "(a.stored = 1 AND NOT (a.expires_at > 0 AND a.expires_at <= b.at_ms))"
_CHECKED = f"(NOT {_FRESH} AND a.stored = 1 AND a.tagged = 1)"
_SAME = f"({_CHECKED} AND b.unchanged)"

#: Reads of one key: kept bytes while fresh, else a fetch, asking first whether they changed where they have a tag.
READS = Machine(
    fields=(
        ("stored", "BIGINT", "0", f"CASE WHEN {_FRESH} OR {_SAME} THEN 1 WHEN b.keeps THEN 1 ELSE a.stored END"),
        ("tagged", "BIGINT", "0", f"CASE WHEN {_FRESH} OR {_SAME} THEN a.tagged WHEN b.keeps THEN CASE WHEN b.tag THEN 1 ELSE 0 END ELSE a.tagged END"),
        ("expires_at", "BIGINT", "0", f"CASE WHEN {_FRESH} THEN a.expires_at WHEN {_SAME} OR b.keeps THEN b.at_ms + b.age_ms ELSE a.expires_at END"),
        ("size", "BIGINT", "0", f"CASE WHEN {_FRESH} OR {_SAME} OR NOT b.keeps THEN a.size ELSE b.n_bytes END"),
        ("hits", "BIGINT", "0", f"a.hits + CASE WHEN {_FRESH} THEN 1 ELSE 0 END"),
        ("stale", "BIGINT", "0", f"a.stale + CASE WHEN a.stored = 1 AND NOT {_FRESH} THEN 1 ELSE 0 END"),
        ("misses", "BIGINT", "0", f"a.misses + CASE WHEN {_FRESH} THEN 0 ELSE 1 END"),
        ("revalidations", "BIGINT", "0", f"a.revalidations + CASE WHEN {_CHECKED} THEN 1 ELSE 0 END"),
        ("revalidated", "BIGINT", "0", f"a.revalidated + CASE WHEN {_SAME} THEN 1 ELSE 0 END"),
        ("kept_bytes", "BIGINT", "0", f"a.kept_bytes + CASE WHEN {_FRESH} OR {_SAME} THEN a.size ELSE 0 END"),
        ("network_bytes", "BIGINT", "0", f"a.network_bytes + CASE WHEN {_FRESH} OR {_SAME} THEN 0 ELSE b.n_bytes END"),
    ),
    inputs=(("at_ms", "BIGINT"), ("age_ms", "BIGINT"), ("n_bytes", "BIGINT"), ("tag", "BOOLEAN"), ("unchanged", "BOOLEAN"), ("keeps", "BOOLEAN")),
)

#: Requests for one key: one that comes while a fetch runs shares it and counts as a hit.
SHARED = Machine(
    fields=(
        ("until_ms", "BIGINT", "0", "CASE WHEN b.at_ms < a.until_ms THEN a.until_ms ELSE b.at_ms + b.takes_ms END"),
        ("fetches", "BIGINT", "0", "a.fetches + CASE WHEN b.at_ms < a.until_ms THEN 0 ELSE 1 END"),
        ("joined", "BIGINT", "0", "a.joined + CASE WHEN b.at_ms < a.until_ms THEN 1 ELSE 0 END"),
    ),
    inputs=(("at_ms", "BIGINT"), ("takes_ms", "BIGINT")),
)
