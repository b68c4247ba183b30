"""The store of bytes: batches, replacement, eviction and repeated writes."""

from tessera.sources import store

COLS = "key string, content binary, written_at long, expires_at long, etag string, size string"


def put(spark, folder, batch, rows, most=1000, quota=None):
    made = spark.createDataFrame([(k, None if n is None else bytearray(b"x" * n), at, None, f"e{at}", "other") for k, n, at in rows], COLS)
    store.put(made, str(folder), batch, most, quota)


def held(spark, folder):
    return {r.key: (r.size, len(r.content)) for r in store.read(spark, str(folder)).collect()}


def test_store_keeps_the_last_and_evicts_the_oldest(spark, tmp_path):
    assert held(spark, tmp_path) == {}
    put(spark, tmp_path, 0, [("a", 10, 1), ("a", 20, 2), ("b", None, 3), (None, 5, 4)])
    assert held(spark, tmp_path) == {"a": (20, 20), "b": (0, 0)}
    put(spark, tmp_path, 1, [("c", 50, 7200000), ("a", 30, 3600000)], most=60)
    assert held(spark, tmp_path) == {"c": (50, 50)}
    put(spark, tmp_path, 1, [("c", 50, 7200000), ("a", 30, 3600000)], most=60)  # again, after a failure
    assert held(spark, tmp_path) == {"c": (50, 50)}
    put(spark, tmp_path, 2, [("b", 10, 7200001)], most=60)
    assert held(spark, tmp_path) == {"b": (10, 10), "c": (50, 50)}
    assert store.read(spark, str(tmp_path), spark.createDataFrame([("b",), ("z",)], "key string")).count() == 1


def test_quota_leaves_four_fifths(spark, tmp_path):
    put(spark, tmp_path, 0, [(f"k{k}", 10, k) for k in range(9)], quota=100)
    assert len(held(spark, tmp_path)) == 9
    put(spark, tmp_path, 1, [("new", 5, 50)], quota=100)
    assert set(held(spark, tmp_path)) == {"new", *(f"k{k}" for k in range(2, 9))}


def test_empty_batch(spark, tmp_path):
    put(spark, tmp_path, 0, [])
    assert held(spark, tmp_path) == {}


def test_oldest_beyond_equals_a_loop(spark):
    rows = [(f"k{k}", k * 37 % 50 * 1000000, k % 9 + 1) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, written_at long, size long")
    for most in (0, 100, 555, 5000):
        left, kept = 0, set()
        for key, _, size in sorted(rows, key=lambda r: (-r[1], r[0])):
            left += size
            kept |= {key} if left <= most else set()
        assert {r.key for r in store.oldest_beyond(df, most).collect()} == {r[0] for r in rows} - kept
