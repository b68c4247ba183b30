"""What a device may hold and how many workers it runs, by its profile, cores and gigabytes of memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
# Fixed values by profile: share of the cores, least and most, for decoders of meshes and of textures; milliseconds of a frame.
WORKERS = {"xr": ((0.38, 2, 3), (0.25, 1, 2), 1000 / 72), "mobile": ((0.42, 2, 4), (0.22, 1, 2), 20.0), "desktop": ((0.5, 2, 12), (0.25, 1, 6), 1000 / 60)}
# Fixed values by profile, from weak to strong: tiles, MiB of sources and MiB on the GPU that stay resident.
CAPS = {"xr": ((180, 256, 640),), "mobile": ((240, 320, 896), (360, 512, 1280)), "desktop": ((500, 640, 1536), (800, 1024, 2048), (1200, 1536, 3072))}
CORES, MEMORY = 4, 0  # where they aren't known


def _by_profile(profile: Column, made: dict[str, Column]) -> Column:
    return F.when(profile == "xr", made["xr"]).when(profile == "mobile", made["mobile"]).otherwise(made["desktop"])


def workers(profile: Column, cores: Column) -> tuple[Column, Column, Column]:
    """(decoders of meshes, decoders of textures, target frame time); a profile that is neither xr nor mobile is desktop."""
    known = F.greatest(F.lit(1), F.coalesce(cores, F.lit(CORES)))

    def sized(k: int) -> Column:
        return _by_profile(profile, {p: F.greatest(F.lit(w[k][1]), F.least(F.lit(w[k][2]), F.floor(known * w[k][0]))).cast("int") for p, w in WORKERS.items()})

    return sized(0), sized(1), _by_profile(profile, {p: F.lit(w[2]) for p, w in WORKERS.items()})


def resident_caps(profile: Column, cores: Column, memory_gb: Column) -> Column:
    """A struct of tiles, source_bytes and gpu_bytes."""
    c, m = F.coalesce(cores, F.lit(CORES)), F.coalesce(memory_gb, F.lit(MEMORY))
    caps = {p: [F.struct(F.lit(t).alias("tiles"), F.lit(s * MIB).alias("source_bytes"), F.lit(g * MIB).alias("gpu_bytes")) for t, s, g in tiers] for p, tiers in CAPS.items()}
    weak, strong = caps["mobile"]
    low, high, station = caps["desktop"]
    mobile = F.when((m >= 8) | (c >= 12), strong).otherwise(weak)
    desktop = F.when((m >= 16) | (c >= 24), station).when((m >= 8) & (c >= 16), high).otherwise(low)
    return _by_profile(profile, {"xr": caps["xr"][0], "mobile": mobile, "desktop": desktop})
