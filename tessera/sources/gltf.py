"""Materials, textures, samplers, nodes, scenes and images of binary glTF, with the format's defaults."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .glb import chunks

# Filters and wrapping that a sampler has if it names none.
LINEAR, LINEAR_MIPMAP, REPEAT = 9729, 9987, 10497

_OUT_ROWS, _OUT_BYTES = 8192, 8 << 20

_MATERIAL = (
    "name: string, pbrMetallicRoughness: struct<baseColorFactor: array<double>, baseColorTexture: struct<index: int, extensions: string>>, doubleSided: boolean, alphaMode: string, "
    "alphaCutoff: double, extensions: struct<KHR_materials_unlit: string>"
)
_DOCUMENT = (
    f"materials array<struct<{_MATERIAL}>>, textures array<struct<name: string, source: int, sampler: int>>, "
    "samplers array<struct<magFilter: int, minFilter: int, wrapS: int, wrapT: int>>, "
    "nodes array<struct<name: string, mesh: int, children: array<int>, matrix: array<double>, translation: array<double>, rotation: array<double>, scale: array<double>>>, "
    "scenes array<struct<name: string, nodes: array<int>>>"
)


def documents(files: DataFrame, id_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """(id, doc): the JSON of each container, null where it can't be read."""

    def one(data: bytes | None) -> str | None:
        try:
            return json.dumps(chunks(data or b"")[0])
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], [id_col, "doc"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, bytes_col).mapInArrow(run, f"{id_col} {kind}, doc string")


def _images_of(data: bytes | None) -> list[tuple[int, str, str, bytes]]:
    try:
        doc, binary = chunks(data or b"")
        out = []
        for k, image in enumerate(doc.get("images", ())):
            view = doc["bufferViews"][image["bufferView"]]
            start, n = view.get("byteOffset", 0), view.get("byteLength", 0)
            if image.get("uri") or view.get("buffer", 0) or start + n > len(binary):
                return []
            out.append((k, image.get("name", ""), image["mimeType"], binary[start : start + n]))
        return out
    except (ValueError, KeyError, IndexError, TypeError):
        return []


def image_batches(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """The images of batches (id, bytes), those of many containers in one batch."""

    def pack(ids: pa.Array, of: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.string(), pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *columns], [id_col, "image", "name", "mime", "bytes"])

    for b in batches:
        of, found, held = [], [], 0
        for k, data in enumerate(b.column(1)):
            own = _images_of(data.as_py())
            found += own
            of += [k] * len(own)
            held += sum(len(body) for *_, body in own)
            if len(found) >= _OUT_ROWS or held >= _OUT_BYTES:
                yield pack(b.column(0), of, found)
                of, found, held = [], [], 0
        if found:
            yield pack(b.column(0), of, found)


def images(files: DataFrame, id_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """(id, image, name, mime, bytes): each image inside a container.

    A container that names an image outside itself, or one that leaves its binary chunk, gives none, like one that can't be
    read.
    """
    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, bytes_col).mapInArrow(lambda batches: image_batches(batches, id_col), f"{id_col} {kind}, image int, name string, mime string, bytes binary")


def project(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds arrays materials, textures, samplers, nodes and scenes with defaults filled in; null where the JSON has none.

    ``supported`` is false where the JSON is null or a base colour texture has extensions.
    """
    d = F.from_json(doc, _DOCUMENT)

    def material(m: Column) -> Column:
        pbr = m["pbrMetallicRoughness"]
        return F.struct(
            F.coalesce(m["name"], F.lit("")).alias("name"), F.slice(F.coalesce(pbr["baseColorFactor"], F.array(*[F.lit(1.0)] * 4)), 1, 4).alias("factor"), pbr["baseColorTexture"]["index"].alias("texture"),
            F.coalesce(m["doubleSided"], F.lit(False)).alias("double_sided"), F.coalesce(m["alphaMode"], F.lit("OPAQUE")).alias("alpha_mode"), F.coalesce(m["alphaCutoff"], F.lit(0.5)).alias("alpha_cutoff"),
            m["extensions"]["KHR_materials_unlit"].isNotNull().alias("unlit"),
        )

    def named(x: Column, *fields: str) -> Column:
        return F.struct(F.coalesce(x["name"], F.lit("")).alias("name"), *[x[f].alias(f) for f in fields])

    strange = F.exists(d["materials"], lambda m: m["pbrMetallicRoughness"]["baseColorTexture"]["extensions"].isNotNull())
    return docs.select(
        *[F.col(c) for c in docs.columns if c != doc], (F.col(doc).isNotNull() & ~F.coalesce(strange, F.lit(False))).alias("supported"), F.transform(d["materials"], material).alias("materials"),
        F.transform(d["textures"], lambda t: named(t, "source", "sampler")).alias("textures"),
        F.transform(d["samplers"], lambda s: F.struct(*[F.coalesce(s[f], F.lit(v)).alias(f) for f, v in (("magFilter", LINEAR), ("minFilter", LINEAR_MIPMAP), ("wrapS", REPEAT), ("wrapT", REPEAT))])).alias("samplers"),
        F.transform(d["nodes"], lambda n: named(n, "mesh", "children", "matrix", "translation", "rotation", "scale")).alias("nodes"),
        F.transform(d["scenes"], lambda s: named(s, "nodes")).alias("scenes"),
    )
