"""Readers and URL functions on small inputs, bad ones included."""

import json
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import sessions
from tessera.plans.ingest_queries import container
from tessera.sources import geojson, gltf, tileset


def test_resolve_equals_the_standard_library(spark):
    bases = ["https://h.test/a/b/c.json?x=1", "https://h.test", "https://h.test/d/", "http://h.test:81/a.json#f"]
    uris = ["t.glb", "./t.glb", "../t.glb?q=../z", "/r/t.glb", "https://o.test/x", "../../../t.glb", "s/./u/../t.glb", "a/.."]
    pairs = [(b, u) for b in bases for u in uris] + [(bases[0], None)]
    got = spark.createDataFrame(pairs, "b string, u string").select("b", "u", urls.resolve(F.col("b"), F.col("u")).alias("r")).collect()
    for r in got:
        assert r.r == (urljoin(r.b, r.u) if r.u else None)


def docs(spark, **bodies):
    rows = [(f"http://t/{k}.json", v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in bodies.items()]
    return spark.createDataFrame(rows, "url string, body string")


def test_tileset_opens_named_documents_once(spark):
    kids = [{"content": {"uri": f"{k}.glb"}} for k in range(11)]
    d = docs(spark, root={"root": {"children": [{"content": {"uri": "in.json"}}, {"content": {"uri": "gone.json"}}, {"content": {"uri": "bad.json"}}]}}, bad="{", none=None, **{"in": {"root": {"content": {"uri": "root.json"}, "children": kids}}})
    tree = tileset.read_tileset(d.union(d), "http://t/root.json")
    assert [r.url and r.url[9:] for r in tree.orderBy("path").collect()] == [None, "in.json", "root.json", "gone.json", "bad.json"]
    d = docs(spark, root={"root": {"children": kids}})
    assert [r.url for r in tileset.read_tileset(d, "http://t/root.json").where("depth = 1").orderBy("path").collect()] == [f"http://t/{k}.glb" for k in range(11)]
    assert tileset.read_tileset(d, "http://t/other.json").count() == tileset.read_tileset(d.limit(0), "http://t/root.json").count() == 0


def test_first_ring(spark):
    ring = [[float(k), 0.0] for k in range(100)] + [[0.0, 0.0]]
    shapes = [{"type": "Polygon", "coordinates": [ring]}, {"type": "FeatureCollection", "features": [{"type": "Point"}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring[:3]], [ring]]}}]}, {"type": "Polygon", "coordinates": []}, {"type": "Feature", "geometry": None}]
    rows = [(k, json.dumps(s)) for k, s in enumerate(shapes)] + [(8, "x"), (9, None)]
    got = spark.createDataFrame(rows, "k long, t string").select("k", geojson.corners(geojson.first_ring(F.col("t"))).alias("r")).orderBy("k").collect()
    assert [r.r and len(r.r) for r in got] == [64, 3, None, None, None, None]


def test_sessions(spark):
    log = [(1, 1, "http://t/a?session=x#f", None, True), (1, 2, "http://t/a#f", None, False), (1, 3, "http://t/a?session=y", None, False), (1, 4, "http://t/a?session=z&k=1", "", False), (1, 5, "http://t/a?k=1", "n", False), (1, 6, None, None, False)]
    got = sessions.requests(spark.createDataFrame(log, "source_id long, seq long, url string, given string, root boolean")).orderBy("seq").collect()
    assert [r.request_url for r in got] == ["http://t/a#f", "http://t/a#f", "http://t/a?session=y", "http://t/a?session=y&k=1", "http://t/a?k=1&session=n", None]
    assert [r.session for r in got] == [None, None, "y", "y", "n", "n"]


def test_containers_that_cannot_be_read(spark):
    files = spark.createDataFrame([("a", None), ("b", bytearray(b"x")), ("c", bytearray(container(0.0))), ("d", bytearray(container(0.0, images=[{"uri": "o.png"}])))], "path string, content binary")
    p = {r.path: r for r in gltf.project(gltf.documents(files)).collect()}
    assert [p[k].supported for k in "abcd"] == [False, False, True, True] and p["c"].materials is None
    assert gltf.images(files).count() == 0
