"""The life of a tile's content: requested, loaded through its stages, shown, kept, dropped, failed and retried.

``replay`` folds a finished log with expressions alone.  ``follow`` keeps the same state for each node of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.folds import Machine
from . import states

# Stages by number (0 is none), statuses of absent content, and delays before a retry.
STAGES = ("none", "requested", "downloading", "downloaded", "decoding", "decoded", "preparing", "renderReady", "visible", "resident")
READY, VISIBLE, RESIDENT = 7, 8, 9
ABSENT = (404, 410, 422)
BASE_MS, MOST_MS, ABSENT_MS = 500, 8000, 30000

_LOADING = f"(a.stage > 0 AND a.stage < {READY})"
_ASKED = "(b.event = 'request' AND a.stage = 0 AND a.due_ms <= b.at_ms)"
_DONE = f"(b.event = 'advance' AND a.stage = {READY - 1})"
_FAILED = f"(b.event = 'fail' AND {_LOADING})"
_DROPPED = f"(b.event = 'abort' AND {_LOADING})"
_UNLOADED = f"(b.event = 'abort' AND a.stage >= {READY})"
_DELAY = f"least({MOST_MS}, {BASE_MS} * pow(2, least(a.failures, 10)))"

LIFE = Machine(
    fields=(
        ("stage", "BIGINT", "0", f"CASE WHEN {_ASKED} THEN 1 WHEN b.event = 'advance' AND {_LOADING} THEN a.stage + 1 WHEN {_FAILED} OR b.event = 'abort' THEN 0 WHEN b.event = 'show' AND a.stage >= {READY} THEN {VISIBLE} WHEN b.event = 'hide' AND a.stage = {VISIBLE} THEN {RESIDENT} ELSE a.stage END"),
        ("failures", "BIGINT", "0", f"CASE WHEN {_FAILED} THEN a.failures + 1 WHEN {_DONE} THEN 0 ELSE a.failures END"),
        ("due_ms", "BIGINT", "0", f"CASE WHEN {_FAILED} THEN b.at_ms + CASE WHEN b.status IN {ABSENT} AND a.failures >= 2 THEN greatest({ABSENT_MS}, {_DELAY}) ELSE {_DELAY} END WHEN {_DONE} THEN 0 ELSE a.due_ms END"),
        ("requested", "BIGINT", "0", f"a.requested + CASE WHEN {_ASKED} THEN 1 ELSE 0 END"),
        ("deferred", "BIGINT", "0", f"a.deferred + CASE WHEN b.event = 'request' AND NOT {_ASKED} THEN 1 ELSE 0 END"),
        ("completed", "BIGINT", "0", f"a.completed + CASE WHEN {_DONE} THEN 1 ELSE 0 END"),
        ("recovered", "BIGINT", "0", f"a.recovered + CASE WHEN {_DONE} AND a.failures > 0 THEN 1 ELSE 0 END"),
        ("cancelled", "BIGINT", "0", f"a.cancelled + CASE WHEN {_DROPPED} THEN 1 ELSE 0 END"),
        ("failed", "BIGINT", "0", f"a.failed + CASE WHEN {_FAILED} THEN 1 ELSE 0 END"),
        ("unloaded", "BIGINT", "0", f"a.unloaded + CASE WHEN {_UNLOADED} THEN 1 ELSE 0 END"),
    ),
    inputs=(("at_ms", "BIGINT"), ("event", "STRING"), ("status", "BIGINT")),
)
FIELDS = tuple(n for n, *_ in LIFE.fields)


def replay(log: DataFrame, key: str = "node_id") -> DataFrame:
    """The state of each node after its whole log of (key, at_ms, seq, event, status).

    A request is deferred while content is held or a retry isn't due; an abort drops a load, or unloads what was loaded; a
    failure doubles the delay up to eight seconds, and content absent three times waits half a minute; success forgets
    failures.  Events that don't apply change nothing, and so do null ones.
    """
    return LIFE.run(log, key, ["at_ms", "seq"])


def step(state: dict[str, int], at_ms: int, event: str | None, status: int | None) -> dict[str, int]:
    """The state after one event."""
    s = dict(state)
    loading = 0 < s["stage"] < READY
    if event == "request":
        if s["stage"] == 0 and s["due_ms"] <= at_ms:
            s["stage"] = 1
            s["requested"] += 1
        else:
            s["deferred"] += 1
    elif event == "advance" and loading:
        s["stage"] += 1
        if s["stage"] == READY:
            s["completed"] += 1
            s["recovered"] += s["failures"] > 0
            s["failures"] = s["due_ms"] = 0
    elif event == "fail" and loading:
        delay = min(MOST_MS, BASE_MS * 2 ** min(s["failures"], 10))
        s["failures"] += 1
        if status in ABSENT and s["failures"] >= 3:
            delay = max(delay, ABSENT_MS)
        s["due_ms"] = at_ms + delay
        s["failed"] += 1
        s["stage"] = 0
    elif event == "abort" and s["stage"]:
        s["cancelled" if loading else "unloaded"] += 1
        s["stage"] = 0
    elif event == "show" and s["stage"] >= READY:
        s["stage"] = VISIBLE
    elif event == "hide" and s["stage"] == VISIBLE:
        s["stage"] = RESIDENT
    return s


def follow(stream: DataFrame, key: str = "node_id") -> DataFrame:
    """``replay`` for a stream: in update mode, each micro-batch gives the new state of the nodes that it touched.

    A node's events of one micro-batch are put in order of (at_ms, seq); later micro-batches are taken to come later.
    """
    start = dict.fromkeys(FIELDS, 0)
    return states.follow(stream, key, ["at_ms", "seq"], LIFE, start, ["at_ms", "event", "status"], step)
