"""Adaptive controllers: limits that back off under load and grow again with headroom, as ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import Machine

# Bounds of the controlled limits.
NETWORK, DECODES, PREPARE, SPECULATIVE, LOOK_AHEAD = (64, 128), (6, 12), (2, 14), (4, 24), (0.75, 3.5)
DOWNLOADED_LIMIT_MB = 256

_RATIO = "b.frame_cost / b.target"
_LONG = "b.long_tasks > a.last_long_tasks"
_OVER = f"({_LONG} OR {_RATIO} > 1.12e0)"
_UNDER = f"({_RATIO} > 0 AND {_RATIO} < 0.82e0)"
_BACKLOG = "(b.queued_decode > 0 OR b.downloaded_mb > 8)"
_EAGER = f"({_UNDER} AND b.speed > 5)"
_HEALTHY = f"CASE WHEN {_OVER} OR NOT {_UNDER} THEN 0 ELSE a.healthy + 1 END"
_PRESSED = "(b.pressure OR b.heap > 0.82e0)"
_ROOM = f"(b.heap > 0 AND b.heap < 0.62e0 AND {_RATIO} < 0.95e0 AND {_HEALTHY} >= 10)"

CONTROLLER = Machine(
    fields=(
        ("network", "BIGINT", str(NETWORK[1]), f"CASE WHEN {_OVER} THEN greatest({NETWORK[0]}, a.network - 8) WHEN b.queued_network > 0 AND b.downloaded_mb < {DOWNLOADED_LIMIT_MB} * 0.65e0 THEN least({NETWORK[1]}, a.network + 8) ELSE a.network END"),
        ("decodes", "BIGINT", str(DECODES[1]), f"CASE WHEN {_OVER} THEN greatest({DECODES[0]}, a.decodes - CASE WHEN {_LONG} THEN 2 ELSE 1 END) WHEN {_BACKLOG} THEN least({DECODES[1]}, a.decodes + 1) ELSE a.decodes END"),
        ("prepare_ms", "DOUBLE", str(PREPARE[1]), f"CASE WHEN {_OVER} THEN greatest({PREPARE[0]}, a.prepare_ms * 0.82e0) WHEN b.queued_prepare > 0 AND {_RATIO} < 0.96e0 THEN least({PREPARE[1]}, a.prepare_ms + 0.5e0) ELSE a.prepare_ms END"),
        ("speculative", "BIGINT", "8", f"CASE WHEN {_OVER} THEN greatest({SPECULATIVE[0]}, a.speculative - 2) WHEN {_EAGER} THEN least({SPECULATIVE[1]}, a.speculative + 1) ELSE a.speculative END"),
        ("look_ahead", "DOUBLE", "1.5e0", f"CASE WHEN {_OVER} THEN greatest({LOOK_AHEAD[0]}e0, a.look_ahead - 0.2e0) WHEN {_EAGER} THEN least({LOOK_AHEAD[1]}e0, a.look_ahead + 0.1e0) ELSE a.look_ahead END"),
        ("healthy", "BIGINT", "0", f"CASE WHEN {_PRESSED} OR {_ROOM} THEN 0 ELSE {_HEALTHY} END"),
        ("resident_scale", "DOUBLE", "1", f"CASE WHEN {_PRESSED} THEN greatest(0.35e0, a.resident_scale * 0.75e0) WHEN {_ROOM} THEN least(1e0, a.resident_scale + 0.05e0) ELSE a.resident_scale END"),
        ("last_long_tasks", "BIGINT", "0", "b.long_tasks"),
        ("reason", "BIGINT", "0", f"CASE WHEN {_PRESSED} THEN 1 WHEN {_LONG} THEN 2 WHEN {_OVER} THEN 3 WHEN {_BACKLOG} THEN 4 WHEN {_UNDER} THEN 5 ELSE 6 END"),
    ),
    inputs=(
        ("frame_cost", "DOUBLE"), ("target", "DOUBLE"), ("long_tasks", "BIGINT"), ("speed", "DOUBLE"), ("queued_decode", "BIGINT"), ("downloaded_mb", "DOUBLE"),
        ("queued_prepare", "BIGINT"), ("queued_network", "BIGINT"), ("heap", "DOUBLE"), ("pressure", "BOOLEAN"),
    ),
)

#: What the numbers of ``reason`` mean; 0 is a session that was never sampled.
REASONS = ("initializing", "memory-pressure-eviction", "long-task-backoff", "frame-pressure-backoff", "decode-catchup", "headroom-growth", "steady")


def control(frames: DataFrame, key: str, frame_no: str = "frame_no", sample_frames: int = 30) -> DataFrame:
    """Limits of each session after its last sampled frame; every ``sample_frames``-th frame is a sample.

    ``frames`` has the inputs of CONTROLLER; targets are above zero.  Sessions without a sample have no row.
    """
    return CONTROLLER.run(frames.where(F.col(frame_no) % sample_frames == 0), key, [frame_no])


def resident_limits(scale: F.Column, tiles: int, source_bytes: int, gpu_bytes: int) -> list:  # type: ignore[name-defined]
    """Caps on resident tiles and bytes at a scale, with floors of 32 tiles, 64 MiB and 256 MiB."""
    floors = ((32, tiles, "tiles"), (64 << 20, source_bytes, "source_bytes"), (256 << 20, gpu_bytes, "gpu_bytes"))
    return [F.greatest(F.lit(least), F.floor(scale * base)).cast("long").alias(name) for least, base, name in floors]
