"""The preparation of loaded tiles in phases, a few milliseconds of each frame, simulated for each session."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slots import walk

PHASES = ("instantiate", "hooks", "materials", "textures", "meshes", "finalize")


@dataclass(frozen=True)
class Limits:
    """Bounds of the queue, and what each phase costs: for textures and meshes, one of them."""

    jobs: int = 96
    textures: int = 2
    meshes: int = 4
    budget_ms: float = 6.0
    frame_ms: float = 16.0
    deferral_ms: float = 350.0
    costs: tuple[float, ...] = (1.5, 0.1, 0.4, 0.8, 0.3, 0.2)


def prepare(jobs: Iterable[tuple], limits: Limits) -> Iterator[tuple]:
    """(seq, frame, done frame, steps) of jobs (frame, seq, priority, textures, meshes) in order of frame and seq.

    A frame takes steps of the best job, by priority and then the first, as long as the running estimate of its phase fits what
    is left of the budget, or the job has waited too long; after a step that reaches the deadline it stops.  Textures and
    meshes have a number for each frame besides.  Jobs beyond the cap wait and are let in by priority.
    """
    admitted: dict[int, dict] = {}
    waiting: list[tuple] = []
    estimate: dict[str, float] = {}
    source = iter(jobs)
    head = next(source, None)
    frame = head[0] if head else 0
    while head is not None or admitted or waiting:
        if not admitted and not waiting:
            frame = head[0]
        while head is not None and head[0] <= frame:
            heapq.heappush(waiting, (-head[2], head[1], head)) if len(admitted) >= limits.jobs else admitted.update({head[1]: _job(head)})
            head = next(source, None)
        clock, textures, meshes = 0.0, limits.textures, limits.meshes
        while admitted:
            able = [j for j in admitted.values() if not (j["phase"] == 3 and textures <= 0 or j["phase"] == 4 and meshes <= 0)]
            if not able:
                break
            job = min(able, key=lambda j: (-j["priority"], j["seq"]))
            phase = PHASES[job["phase"]]
            late = (frame - job["frame"]) * limits.frame_ms + clock >= limits.deferral_ms
            if limits.budget_ms - clock < estimate.get(phase, 1.5 if phase == "instantiate" else 0.4) and not late:
                break
            took = 1
            if phase == "textures":
                took = min(job["textures"], textures)
                job["textures"] -= took
                textures -= took
            elif phase == "meshes":
                took = min(job["meshes"], meshes)
                job["meshes"] -= took
                meshes -= took
            cost = limits.costs[job["phase"]] * took
            clock += cost
            estimate[phase] = estimate.get(phase, cost) * 0.8 + cost * 0.2
            job["steps"] += 1
            if not (phase == "textures" and job["textures"] or phase == "meshes" and job["meshes"]):
                job["phase"] += 1
            if job["phase"] == len(PHASES):
                del admitted[job["seq"]]
                yield job["seq"], job["frame"], frame, job["steps"]
                while waiting and len(admitted) < limits.jobs:
                    one = heapq.heappop(waiting)[2]
                    admitted[one[1]] = _job(one)
            if clock >= limits.budget_ms:
                break
        frame += 1


def _job(row: tuple) -> dict:
    frame, seq, priority, textures, meshes = row
    return {"seq": seq, "frame": frame, "priority": priority, "textures": textures, "meshes": meshes, "phase": 0, "steps": 0}


def simulate(df: DataFrame, limits: Limits = Limits(), key: str = "session_id") -> DataFrame:
    """Columns key, seq, frame, done_frame and steps for jobs of (key, seq, frame, priority, textures, meshes).

    seq is unique in a session.  Null counts are 0, a null priority is 0; rows without key, seq or frame don't take part.  An
    empty table gives an empty result; other columns are ignored.
    """
    clean = df.where(F.col(key).isNotNull() & F.col("seq").isNotNull() & F.col("frame").isNotNull()).select(
        key, F.col("frame").cast("long").alias("frame"), F.col("seq").cast("long").alias("seq"),
        *[F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in (("priority", "double"), ("textures", "long"), ("meshes", "long"))],
    )
    return walk(clean, key, ["frame", "seq"], lambda own: prepare(own, limits), "seq long, frame long, done_frame long, steps long")
