"""Binary glTF to columns: container, accessors, and byte counts, in Arrow batches."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the container and of accessors.
MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
COMPONENTS = {5120: np.int8, 5121: np.uint8, 5122: np.int16, 5123: np.uint16, 5125: np.uint32, 5126: np.float32}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}


def chunks(data: bytes) -> tuple[dict, bytes]:
    """The JSON and binary chunks of a container; the last of each kind counts."""
    if len(data) < 12:
        raise ValueError("too short")
    magic, version, size = struct.unpack_from("<III", data)
    if magic != MAGIC or version != 2 or not 12 <= size <= len(data):
        raise ValueError("not a version 2 container")
    doc, binary, at = None, b"", 12
    while at + 8 <= size:
        n, kind = struct.unpack_from("<II", data, at)
        if at + 8 + n > size:
            raise ValueError("chunk leaves the container")
        if kind == JSON_CHUNK:
            doc = json.loads(data[at + 8 : at + 8 + n].rstrip(b"\0 "))
        elif kind == BIN_CHUNK:
            binary = data[at + 8 : at + 8 + n]
        at += 8 + n
    if doc is None:
        raise ValueError("no JSON chunk")
    return doc, binary


def accessor(doc: dict, binary: bytes, index: int) -> np.ndarray:
    """Values of an accessor, one row for each element; normalised integers become numbers up to 1."""
    a = doc["accessors"][index]
    if "sparse" in a:
        raise ValueError("sparse accessor")
    view = doc["bufferViews"][a["bufferView"]]
    kind, width, count = np.dtype(COMPONENTS[a["componentType"]]).newbyteorder("<"), WIDTHS[a["type"]], a["count"]
    stride = view.get("byteStride") or kind.itemsize * width
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    if stride < kind.itemsize * width or count and start + (count - 1) * stride + kind.itemsize * width > min(len(binary), view.get("byteOffset", 0) + view["byteLength"]):
        raise ValueError("accessor out of range")
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(binary, np.uint8, offset=start), (count, kind.itemsize * width), (stride, 1)) if count else np.zeros((0, kind.itemsize * width), np.uint8)
    out = np.ascontiguousarray(rows).view(kind).reshape(count, width)
    if a.get("normalized") and kind.kind in "iu":
        return np.maximum(out / np.iinfo(kind).max, -1.0)
    return out


def refusal(doc: dict) -> str | None:
    """Why a document can't be read, or nothing."""
    if float(doc.get("asset", {}).get("version", "0")) < 2:
        return "asset version"
    if set(doc.get("extensionsRequired", ())) - {"KHR_materials_unlit"}:
        return "required extension"
    if len(doc.get("buffers", ())) != 1 or "uri" in doc["buffers"][0]:
        return "external buffer"
    if doc.get("skins") or doc.get("animations"):
        return "skin or animation"
    for mesh in doc.get("meshes", ()):
        for p in mesh["primitives"]:
            if p.get("mode", 4) != 4 or p.get("targets") or "POSITION" not in p.get("attributes", {}):
                return "primitive"
    return None


def parse(data: bytes | None) -> dict:
    """One row: whether it could be read, why not, counts of meshes and vertices, bounds, and bytes of images and streams."""
    out = {"supported": False, "reason": None, "primitives": 0, "vertices": 0, "triangles": 0, "low": None, "high": None, "image_bytes": 0, "stream_bytes": 0}
    try:
        doc, binary = chunks(data or b"")
        out["reason"] = refusal(doc)
        if out["reason"]:
            return out
        low, high = np.full(3, np.inf), np.full(3, -np.inf)
        for mesh in doc.get("meshes", ()):
            for p in mesh["primitives"]:
                streams = {name: accessor(doc, binary, i) for name, i in p["attributes"].items()}
                at = streams["POSITION"]
                index = accessor(doc, binary, p["indices"]) if "indices" in p else np.arange(len(at))[:, None]
                out["primitives"] += 1
                out["vertices"] += len(at)
                out["triangles"] += len(index) // 3
                out["stream_bytes"] += 4 * (sum(s.size for s in streams.values()) + index.size)
                if len(at):
                    low, high = np.minimum(low, at.min(axis=0)), np.maximum(high, at.max(axis=0))
        out["image_bytes"] = sum(doc["bufferViews"][i["bufferView"]]["byteLength"] for i in doc.get("images", ()) if "bufferView" in i)
        out |= {"supported": True, "low": low.tolist() if out["vertices"] else None, "high": high.tolist() if out["vertices"] else None}
    except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
        out["reason"] = f"malformed: {e}"[:200]
    return out


_TYPES = pa.schema([("supported", pa.bool_()), ("reason", pa.string()), ("primitives", pa.int64()), ("vertices", pa.int64()), ("triangles", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("image_bytes", pa.int64()), ("stream_bytes", pa.int64())])


def read_glb(files: DataFrame, id_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """One row for each container of a table of paths and bytes, such as the binaryFile source gives; nothing raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.RecordBatch.from_pylist([parse(x) for x in b.column(1).to_pylist()], _TYPES)
            yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], [id_col, *_TYPES.names])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, bytes_col).mapInArrow(run, f"{id_col} {kind}, supported boolean, reason string, primitives long, vertices long, triangles long, low array<double>, high array<double>, image_bytes long, stream_bytes long")
