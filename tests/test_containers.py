"""How containers are dealt to tasks, and how their images are put into batches."""

import pyarrow as pa

from tessera.plans import source_queries
from tessera.plans.ingest_queries import container
from tessera.sources import gltf

SF_DIR = "/root/testdata/sf0.001"


def two(k):
    """A container of two images."""
    return container(0.0, images=[{"bufferView": v, "mimeType": "image/png", "name": f"i{k}.{v}"} for v in (1, 0)])


def test_images_of_many_containers_share_a_batch():
    files = [two(k) if k % 5 else b"x" for k in range(100)] + [None, container(0.0), container(0.0, images=[{"uri": "o.png"}])]
    got = list(gltf.image_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(files))), pa.array(files, pa.binary())], ["k", "content"])]), "k"))
    assert len(got) == 1 and got[0].schema.names == ["k", "image", "name", "mime", "bytes"]
    want = [(k, n, f"i{k}.{v}", "image/png", size) for k in range(100) if k % 5 for n, v, size in ((0, 1, 6), (1, 0, 36))]
    assert [(*r[:4], len(r[4])) for r in zip(*(c.to_pylist() for c in got[0].columns))] == want


def test_large_images_end_a_batch(monkeypatch):
    monkeypatch.setattr(gltf, "_OUT_BYTES", 100)
    files = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([two(k) for k in range(7)], pa.binary())], ["k", "content"])
    got = list(gltf.image_batches(iter([files]), "k"))
    assert [b.num_rows for b in got] == [6, 6, 2] and [k for b in got for k in b.column(0).to_pylist()] == [k // 2 for k in range(14)]


def test_containers_of_one_split_are_made_by_many_tasks(spark):
    made = source_queries._containers(spark, SF_DIR)
    assert spark.read.parquet(f"{SF_DIR}/part.parquet").rdd.getNumPartitions() == 1 and made.rdd.getNumPartitions() > 1
