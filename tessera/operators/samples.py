"""The registry of ground samples: entities that wait for ground to stream in, and entities that stand on a mesh.

A sample's log has events with the probe that was taken at that moment: ``mesh`` and ``height`` of its hit, null on a miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import Machine

# Fixed value: passes over the registry that come sooner than this after the last one don't run.
DEBOUNCE_MS = 250
EVENTS = ("queue", "track", "forget", "unload", "resolve", "reprobe", "force")

_HIT = "(b.mesh IS NOT NULL)"
_WAITS = "(b.event = 'resolve' AND a.pending = 1)"
_PROMOTED = f"({_WAITS} AND {_HIT})"
_SUSPECT = f"(a.active = 1 AND ((b.event IN ('resolve', 'reprobe') AND a.alive = 0 AND NOT {_PROMOTED}) OR b.event = 'force'))"
_RENEWED = f"({_SUSPECT} AND {_HIT})"
_DEMOTED = f"({_SUSPECT} AND NOT {_HIT} AND a.alive = 0)"
_PLACED = f"({_PROMOTED} OR {_RENEWED} OR (b.event = 'track' AND {_HIT}))"

REGISTRY = Machine(
    fields=(
        ("pending", "BIGINT", "0", f"CASE WHEN b.event = 'queue' OR {_DEMOTED} THEN 1 WHEN b.event = 'forget' OR {_PROMOTED} THEN 0 ELSE a.pending END"),
        ("active", "BIGINT", "0", f"CASE WHEN {_PLACED} THEN 1 WHEN b.event = 'forget' OR {_DEMOTED} THEN 0 ELSE a.active END"),
        ("on_mesh", "BIGINT", "-1", f"CASE WHEN {_PLACED} THEN b.mesh ELSE a.on_mesh END"),
        ("alive", "BIGINT", "0", f"CASE WHEN {_PLACED} THEN 1 WHEN b.event = 'unload' AND a.on_mesh = b.mesh THEN 0 ELSE a.alive END"),
        ("ground", "DOUBLE", "NULL", f"CASE WHEN {_PLACED} THEN b.height ELSE a.ground END"),
        ("resolved", "BIGINT", "0", f"a.resolved + CASE WHEN {_PROMOTED} OR {_RENEWED} THEN 1 ELSE 0 END"),
        ("demoted", "BIGINT", "0", f"a.demoted + CASE WHEN {_DEMOTED} THEN 1 ELSE 0 END"),
        ("probes", "BIGINT", "0", f"a.probes + CASE WHEN {_WAITS} OR {_SUSPECT} THEN 1 ELSE 0 END"),
    ),
    inputs=(("event", "STRING"), ("mesh", "BIGINT"), ("height", "DOUBLE")),
)
FIELDS = tuple(n for n, *_ in REGISTRY.fields)
START = {"pending": 0, "active": 0, "on_mesh": -1, "alive": 0, "ground": None, "resolved": 0, "demoted": 0, "probes": 0}

#: When a registry's passes ran, over the moments at which one was asked for.
PASSES = Machine(
    fields=(
        ("last_ms", "BIGINT", "-9000000000", f"CASE WHEN b.at_ms - a.last_ms >= {DEBOUNCE_MS} THEN b.at_ms ELSE a.last_ms END"),
        ("ran", "BIGINT", "0", f"a.ran + CASE WHEN b.at_ms - a.last_ms >= {DEBOUNCE_MS} THEN 1 ELSE 0 END"),
        ("skipped", "BIGINT", "0", f"a.skipped + CASE WHEN b.at_ms - a.last_ms >= {DEBOUNCE_MS} THEN 0 ELSE 1 END"),
    ),
    inputs=(("at_ms", "BIGINT"),),
)


def registry(log: DataFrame, key: str = "sample_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The state of each sample after its log of (key, order, event, mesh, height), and whether it ``needs_resample``.

    ``queue`` makes it wait; ``track`` places it on a mesh; ``unload`` tells that a mesh left; ``resolve`` promotes one that
    waits, and probes one whose mesh left; ``reprobe`` does the latter alone; ``force`` probes even while the mesh is there,
    and then keeps the last height on a miss.  A miss without a mesh demotes to waiting and keeps the height as well.
    ``forget`` ends both.  Other events, null ones and tracking without a mesh change nothing; an empty log gives no row.
    """
    found = REGISTRY.run(log, key, list(order))
    return found.withColumn("needs_resample", (F.col("pending") == 1) | ((F.col("active") == 1) & (F.col("alive") == 0)))


def step(state: dict, event: str | None, mesh: int | None, height: float | None) -> dict:
    """The state after one event, in plain Python, for streams."""
    s = dict(state)

    def place() -> None:
        s.update(active=1, on_mesh=mesh, alive=1, ground=height)

    if event == "queue":
        s["pending"] = 1
    elif event == "forget":
        s["pending"] = s["active"] = 0
    elif event == "track" and mesh is not None:
        place()
    elif event == "unload" and mesh is not None and mesh == s["on_mesh"]:
        s["alive"] = 0
    elif event in ("resolve", "reprobe", "force"):
        waits = event == "resolve" and s["pending"]
        suspect = s["active"] and (event == "force" or not s["alive"]) and not (waits and mesh is not None)
        s["probes"] += 1 if waits or suspect else 0
        if (waits or suspect) and mesh is not None:
            if waits:
                s["pending"] = 0
            place()
            s["resolved"] += 1
        elif suspect and not s["alive"]:
            s["pending"], s["active"] = 1, 0
            s["demoted"] += 1
    return s


def unloaded(samples: DataFrame, meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached samples that stay, active ones with ``alive``) once the meshes of ``meshes`` (column mesh) have left.

    Samples without a mesh stay and are not alive.  Meshes may repeat.
    """
    gone = meshes.select("mesh").where("mesh is not null").distinct()
    marked = samples.join(gone.withColumn("_gone", F.lit(True)), "mesh", "left")
    return samples.join(gone, "mesh", "left_anti"), marked.withColumn("alive", F.col("mesh").isNotNull() & F.col("_gone").isNull()).drop("_gone")
