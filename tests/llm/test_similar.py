"""The pipeline's near copies against all pairs, on planted copies."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Texts, some with copies of about similarity 0.8, a crowd of copies of one text, and edge cases."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    out = {1: None, 2: "", 3: " \t", 4: "one two", 5: "One  two", 6: "one two three four five six", 7: "one two three four five six seven"}
    for k in range(100, 160):
        out[k] = " ".join(rng.choice(words) for _ in range(rng.randint(40, 300)))
        copy = out[k].split()
        for _ in range(max(1, len(copy) // rng.choice((30, 45, 60)))):
            copy[rng.randrange(len(copy))] = "changed"
        out[k + 100] = " ".join(copy)
    crowd = [rng.choice(words) for _ in range(120)]
    for k in range(300, 340):
        out[k] = " ".join([*crowd[: 60 + k % 3], rng.choice(words), *crowd[60:]])
    for k in range(400, 440):  # a common passage alone makes no copy
        out[k] = " ".join([*crowd[:30], *(rng.choice(words) for _ in range(60))])
    return out


def components(texts):
    def cut(t):
        x = (t or "").lower().split()
        return {tuple(x)} if len(x) <= 5 else {tuple(x[k : k + 5]) for k in range(len(x) - 4)}

    sets, up = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}


def test_pipeline_drops_planted_near_copies(spark, tmp_path):
    texts = planted()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(None, texts[100], "en", "s", 1), (None, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    want = components(texts)
    due = {i for i, c in want.items() if i != c}
    assert len(due & set(range(200, 260))) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect() if r.doc_id is not None}
    assert all(want[i] == want[c] for i, c in got.items())  # no pair below 0.8 is linked
    missed = {i for i in due if got[i] == i}
    assert len(missed) <= len(due) // 20 and not missed & set(range(300, 340))
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect()]
    assert set(kept) == {i for i, c in got.items() if i == c} and len(kept) == len(set(kept))
    assert simhash.similar_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [8192, 3])
def test_crowded_keys_are_split_without_loss(spark, block):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, block=block).collect()}
    assert got == {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}


def test_across_gives_every_pair_of_labels():
    rng = np.random.default_rng(2)
    n = 300
    key, label = rng.integers(0, 12, n), rng.integers(0, 6, n)
    by = np.lexsort((label, key))
    key, label, word = key[by], label[by], np.zeros(n, np.int64)
    got = [(i, j) for a, b in simhash.across(key, label, word) for i, j in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and label[i] != label[j]}


def joined(n, pairs):
    up = list(range(n))
    for a, b in pairs:
        up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    return up


def test_a_group_of_one_key_is_not_offered_in_pairs():
    n = 400
    key = np.concatenate([np.zeros(n, np.int64), [1, 1]])
    label, word = np.arange(n + 2), np.zeros(n + 2, np.int64)
    got = [(i, j, crowd) for a, b, crowd in simhash.offers(key, label, word) for i, j in zip(a.tolist(), b.tolist())]
    assert [(i, j) for i, j, crowd in got if not crowd] == [(n, n + 1)]
    edges = [(i, j) for i, j, crowd in got if crowd]
    assert len(edges) <= 2 * n and set(joined(n, edges)) == {0}
    assert all(len(a) == len(b) for a, b, _ in simhash.offers(key[:0], label[:0], word[:0]))


@pytest.mark.parametrize("blocks", [1, 2])
def test_alike_connects_what_all_pairs_connect(blocks):
    rng = np.random.default_rng(6)
    base = rng.permutation(5000)[:120]
    sets = []
    for k in range(150):
        x = base.copy()
        change = rng.integers(0, 30)
        x[rng.permutation(120)[:change]] = 10000 + rng.integers(0, 500 if k % 2 else 10**9, change)
        sets.append(np.unique(x[: rng.integers(90, 121)]))
    sets += [np.array([7]), np.array([7, 8, 9, 10]), np.array([7, 8, 9, 10, 11])]
    n, block = len(sets), rng.integers(0, blocks, len(sets))
    own = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]) and (blocks == 1 or block[i] != block[j])}
    a, b = simhash.alike(sets, block)
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert got <= want and len(got) < n < len(want) and joined(n, got) == joined(n, want)


def test_crowds_of_texts_below_the_limit_keep_their_links(spark, monkeypatch):
    """Copies of one text at every similarity, most pairs below 0.8: few pairs are asked for, few copies missed, none linked wrongly."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base, texts = [rng.choice(words) for _ in range(150)], {}
    for k in range(200):
        x = list(base)
        for _ in range(rng.randrange(12)):
            x[rng.randrange(len(x))] = f"new{rng.randrange(10**6)}"
        texts[k] = " ".join(x)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    asked = []
    monkeypatch.setattr(simhash, "_within", lambda pairs, *more, was=simhash._within: asked.append(pairs.count()) or was(pairs, *more))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    want = components(texts)
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == i != c for i, c in want.items()) <= 2  # that share no key with any other
    assert max(asked) < 10 * len(texts)
    monkeypatch.setattr(simhash, "CROWD_TEXTS", 30)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == got


def test_pairs_of_one_crowd_are_left_to_it(spark, monkeypatch):
    """What a crowd compares is not fetched and compared once more as pairs, and no link is lost by that."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base, texts = [rng.choice(words) for _ in range(150)], {}
    for k in range(400):
        x = list(base)
        for _ in range(rng.randrange(12)):
            x[rng.randrange(len(x))] = f"new{rng.randrange(10**6)}"
        texts[k] = " ".join(x)
    made = []

    def within(pairs, *more, was=simhash._within):
        made.append((pairs.count(), was(pairs, *more).count()))
        return was(pairs, *more)

    monkeypatch.setattr(simhash, "_within", within)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    want = components(texts)
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == i != c for i, c in want.items()) <= 4
    asked, left = made[-1]
    assert asked > len(texts) and left < asked // 4


def test_wide_fingerprints_count_bits():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 254, 255, 256, 1000])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), np.int64).view(np.uint64)
    got = simhash.wide_fingerprints(hashes, sizes)
    at = 0
    for row, n in zip(got, sizes):
        for w in range(simhash.WORDS):
            ones = [0] * 64
            for h in hashes[at : at + n].tolist():
                x = ((h ^ (0xA24BAED4963EE407 * (w + 1) % (1 << 64))) * 0x9E3779B97F4A7C15) % (1 << 64)
                x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % (1 << 64)
                x ^= x >> 32
                for k in range(64):
                    ones[k] += x >> k & 1
            assert int(row[w]) == sum(1 << k for k in range(64) if 2 * ones[k] > n)
        at += n


def test_keys_are_shared_by_segments_of_one_differing_bit(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(simhash.WORDS)]
    rows = []
    for w in range(simhash.WORDS):
        for lo, hi in zip(simhash.SEGMENTS, simhash.SEGMENTS[1:]):
            for bit in (lo, hi - 2):
                noise = rng.getrandbits(63) & ~(((1 << hi) - (1 << lo)))
                rows.append((w, bit, (base[w] ^ noise ^ (1 << bit)) % (1 << 63)))
    made = spark.createDataFrame([(w, -1, base[w]) for w in range(simhash.WORDS)] + rows, "at int, bit_ int, fp long")
    keys = {}
    for r in simhash._index(made).collect():
        keys.setdefault(r.key, set()).add((r.bit_, r.fp))
    for w, bit, fp in rows:
        assert {(-1, base[w]), (bit, fp)} <= keys[(w * 64 + bit << 22) + next(((base[w] >> lo) & ((1 << hi - lo) - 1) & ~(1 << bit - lo)) for lo, hi in zip(simhash.SEGMENTS, simhash.SEGMENTS[1:]) if lo <= bit < hi)]


def test_sieve_parts_rows_and_loses_none(spark):
    rows = spark.createDataFrame([(k if k % 50 else None, "x", 1) for k in range(3000)], "id long, _bits_of string, other int")
    ids = spark.createDataFrame([(k,) for k in range(7, 3000, 29)], "wanted long")
    some, others = common.sieved(rows, "id", ids, "wanted")
    assert some.columns == others.columns == rows.columns
    a, b = [r.id for r in some.collect()], [r.id for r in others.collect()]
    assert len(a) + len(b) == 3000 and b.count(None) == 60 and not set(b) & set(range(7, 3000, 29))
    assert len(a) <= 2 * ids.count()
    none, every = common.sieved(rows, "id", ids.limit(0), "wanted")
    assert none.isEmpty() and every.count() == 3000
