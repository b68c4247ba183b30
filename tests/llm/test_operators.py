"""Corpus operators against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import bisect
import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, exact_dedup, html_text, langid, licences, neighbours, packing, sharding, simhash, suffix_dedup
from tessera.llm.suffix_array import permuted_lcp, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, fp string"
PASSAGE = "It was a bright cold day in April, and the clocks were striking thirteen; he slipped quickly through the glass doors of the hall. "


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "été", "straße", "niño", "x"]
    out = {1: None, 2: "", 3: " \t\n", 4: "a", 5: "!!! 123", 6: "a  b", 7: "ab", 8: " ab ", 9: PASSAGE * 3, 10: "start " + PASSAGE + "end", 11: "other " + PASSAGE}
    for k in range(12, 60):
        out[k] = " ".join(rng.choice(words) for _ in range(rng.randint(5, 120)))
    for k in range(60, 80):
        out[k] = out[k - 40]
    for k in range(80, 90):
        out[k] = out[k - 50] + " tail"
    out[90] = " ".join(rng.choice(words) for _ in range(20000))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "clash", "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [*texts().items(), (60, texts()[60]), (None, "nobody's text")])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_sharding_keeps_groups_and_balances(docs, empty):
    rows = sharding.shard_rows(docs, 4).collect()
    assert len(rows) == docs.count()
    shards, loads = {}, [0] * 4
    for r in rows:
        text = texts().get(r.doc_id, "nobody's text") or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode())) and r.law == "bytes" and r.grown_shard is None
        assert shards.setdefault(text, r.shard) == r.shard
        loads[r.shard] += r.size
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted(loads)[2] - min(loads) < 1200  # the fourth holds one long text
    assert sharding.shard_rows(empty, 4).collect() == []


def one_by_one(sizes, shards):
    heap, loads = [(0, s) for s in range(shards)], [0] * shards
    for size in sorted((k for k, n in sizes.items() for _ in range(n)), reverse=True):
        load, s = heapq.heappop(heap)
        loads[s] += size
        heapq.heappush(heap, (load + size, s))
    return loads


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_schedule_is_longest_first(shards):
    for seed in range(30):
        rng = random.Random(seed)
        sizes = {rng.randint(1, 400): rng.choice((1, 2, 7, 300, 5000)) for _ in range(25)}
        loads, taken = [0] * shards, {}
        for size, low, high, shard in sharding.schedule(sizes, shards):
            loads[shard] += size * (high - low)
            assert low == taken.get(size, 0)
            taken[size] = high
        assert taken == sizes and loads == one_by_one(sizes, shards)


def test_sharding_spreads_over_forty(spark):
    rng = random.Random(8)
    made = ["x" * int(rng.lognormvariate(6, 1)) + str(k) for k in range(4000)]
    rows = [(None if k % 3 == 0 else k, t) for k, t in enumerate(made)] + [(None, "the same text")] * 900 + [(5, made[5])] * 3
    got = sharding.shard_rows(table(spark, rows)).collect()
    loads = [0] * 40
    for r in got:
        loads[r.shard] += r.size
    sizes = {}
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 16
    for size in groups.values():
        sizes[size] = sizes.get(size, 0) + 1
    assert len(got) == len(rows) and loads == one_by_one(sizes, 40)
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(1 for r in got if r.shard == s)))


def components_by_hand(prints):
    up = {i: i for i in prints}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("block", [8192, 2])
def test_simhash_matches_all_pairs(docs, empty, block):
    rows = simhash.near_duplicates(docs, block=block).collect()
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts().items()}
    want = components_by_hand(prints)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    if block == 2:
        assert simhash.near_duplicates(empty).collect() == []


def test_simhash_links_random_neighbours():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fp = sorted({b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in range(6)})
    links = set()
    for key in range(64):
        lo, hi = next((a, b) for a, b in zip(simhash.SEGMENTS, simhash.SEGMENTS[1:]) if a <= key < b)
        mask = ((1 << hi) - (1 << lo)) & ~(1 << key)
        rows = sorted((f & mask, f) for f in fp)
        part = {m: k for k, m in enumerate(sorted({m for m, _ in rows}))}
        keys = np.array([(key << 22) + part[m] for m, _ in rows])
        none = np.zeros(len(rows), np.int64)
        a, b = simhash.verified_links(keys, none, np.array([f for _, f in rows], np.uint64), none)
        links |= {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())}
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
    up = {f: f for f in fp}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    assert {f: top(f) for f in fp} == components_by_hand({f: f for f in fp})


def test_language(spark, empty):
    rows = [(k, " ".join(random.Random(k).sample(["the", "house", "and", "water", "with"], 5)), "en") for k in range(80)] + [(100 + k, " ".join(random.Random(k).sample(["der", "haus", "und", "wasser", "mit"], 5)), "de") for k in range(80)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (503, "the house " * 3000, None), (None, "und das wasser", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    told = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for k in range(80):
        assert (told[k].lang_pred, told[100 + k].lang_pred) == ("en", "de")
        assert told[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert [told[k].lang_pred for k in (500, 501, 502, 503, None)] == ["und", "und", "und", "en", "de"]
    assert told[500].rejected and all(0 <= r.score <= 1 for r in told.values())
    nothing = langid.fit(empty)
    assert langid.identify(empty, nothing).collect() == [] and langid.identify(docs, nothing).where("lang_pred <> 'und'").count() == 0
    clash = docs.select("*", F.lit("x").alias("score"), F.lit("x").alias("rejected"), F.lit(1).alias("held_out"))
    assert sorted(langid.identify(clash, model).columns) == ["doc_id", "held_out", "lang_pred", "rejected", "score"]


STEMS = {"en": "the house and water with there would people first think", "de": "der haus und wasser mit nicht werden leute zuerst denken", "fr": "la maison et eau avec pas seraient gens premier penser"}


def sentences(lang, n, seed=0):
    rng = random.Random(seed + zlib.crc32(lang.encode()))
    return [" ".join(rng.choice(STEMS[lang].split()) for _ in range(rng.randint(3, 40))) for _ in range(n)]


@pytest.mark.parametrize("langs", [("en", "de"), ("en", "de", "fr")])
def test_language_rejects_what_it_never_learned(langs):
    model = langid.train([(t, lang) for lang in langs for t in sentences(lang, 120)])
    for lang in langs:
        told = [model.predict(t) for t in sentences(lang, 100, 99)]
        assert all(x[0] == lang for x in told) and sum(x[2] for x in told) <= 2
    strange = ["это совсем другой язык и его никто не учил", "これはまったく別の言語です", "xqzv kjwpf qqgz vkzx wjqk zzpx", "ez egy teljesen másik nyelv amelyet senki sem tanult"]
    assert all(model.predict(t)[2] for t in strange)
    assert model.predict("a b c")[0] in langs and model.predict(None) == model.predict("12 !") == ("und", 0.0, True)
    assert 0.01 < model.temperature < 100
    tied = langid.train([("same words here", "b"), ("same words here", "a")] * 30)
    assert 0 <= tied.predict("same words here")[1] <= 0.7


def test_language_learns_every_language():
    rng = random.Random(4)
    stems = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for k in range(510)}
    model = langid.train([(" ".join(rng.sample(words, 5)), lang) for lang, words in stems.items() for _ in range(3)], epochs=2)
    assert len(model.langs) == 510


def removed_by_hand(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            w = data[p : p + size]
            if w in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [3000, 2])
def test_suffix_dedup_matches_windows(docs, empty, crowd):
    rows = suffix_dedup.remove_repeats(docs, crowd=crowd).collect()
    want = removed_by_hand(texts())
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    if crowd == 2:
        assert suffix_dedup.remove_repeats(empty).collect() == []


def test_suffix_dedup_takes_rows_of_one_id_apart(spark):
    rows = [(None, "a" + PASSAGE), (None, "b" * 200), (None, "a" + PASSAGE), (4, PASSAGE + "x"), (4, "y" * 30 + PASSAGE), (7, "end")]
    table_ = spark.createDataFrame([(i, t, "c", "n") for i, t in rows], "doc_id long, text string, kept string, n_bytes string")
    got = suffix_dedup.remove_repeats(table_).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in got) == sorted((i is None, len(t)) for i, t in rows)
    assert sum(r.n_removed for r in got if r.doc_id is None) == len(PASSAGE) + 1 + 199  # the second copy, and all but the first b
    assert sorted(r.kept.decode() for r in got if r.doc_id == 4) == ["x", "y" * 30]


def rows_to_compare(texts_, size):
    """The rows of the first step, in the order that the second takes them, and their batches' names."""
    docs_ = pa.RecordBatch.from_arrays([pa.array(list(texts_)), pa.array([t.encode() for t in texts_.values()])], ["doc", "text"])
    rows = [r for b in suffix_dedup._scan(size)(iter([docs_])) for r in zip(*(c.to_pylist() for c in b.columns))]
    return sorted(rows)


def compared(rows, size, most, batch):
    cut = [rows[k : k + batch] for k in range(0, len(rows), batch)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], suffix_dedup._ROW) for some in cut]
    return [r for b in suffix_dedup._compare(size, most)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]


@pytest.mark.parametrize("most", [1 << 18, 2])
@pytest.mark.parametrize("size", [100, 40, 33, 223])
def test_suffix_dedup_asks_for_all_windows_that_repeat(size, most):
    rng = random.Random(size)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.choice([3, 20, 60, 90, 130, 260]))) for _ in range(12)] + ["the " * 50]
    texts_ = {i: "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("cdef ") for _ in range(rng.randint(1, 60))) for _ in range(8)) for i in range(60)}
    found = compared(rows_to_compare(texts_, size), size, most, 7)
    gone = {(doc, at) for kind, _, doc, start, span in found if not kind for at in range(start, start + span)}
    asked = [(doc, start, texts_[doc][start : start + (span >> 8)].encode()) for kind, _, doc, start, span in found if kind]
    for doc, start, end in zip(*suffix_dedup.repeated(asked, size)):
        gone |= {(doc, at) for at in range(start, end)}
    want = removed_by_hand(texts_, size)
    assert len(gone) > 1000
    for i, t in texts_.items():
        left = "".join(x for at, x in enumerate(t) if (i, at) not in gone).encode()
        assert hashlib.sha256(left).hexdigest() == want[i][3]


def test_suffix_dedup_does_not_ask_for_a_common_line_among_differing_neighbours():
    rng = random.Random(5)
    line = "a line of some seventy bytes that very many documents of the corpus hold"
    texts_ = {i: "".join(rng.choice("abcdefgh") for _ in range(150)) + line + "".join(rng.choice("abcdefgh") for _ in range(150)) for i in range(300)}
    assert len(line) < 78  # shorter than a core and no less than an anchor
    assert not any(r[0] for r in compared(rows_to_compare(texts_, 100), 100, 1 << 18, 1000))


def test_suffix_array_and_prefixes():
    for seed in range(200):
        rng = random.Random(seed)
        data = bytes(rng.randint(0, rng.choice([1, 2, 30, 255])) for _ in range(rng.randint(0, 50))) * rng.choice([1, 1, 3])
        t = np.frombuffer(data, np.uint8)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = permuted_lcp(t, sa)
        for a, b in zip(sa, sa[1:]):
            x, y = data[a:], data[b:]
            assert shared[b] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


PAGE = """<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies here</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b> words.<br><p>Be.</p><div class=ad>Buy</div><form><p>Subscribe now</p></form></article><section class="comments"><article><p>A reader wrote many words in this place, really.</p></article></section><aside>Aside</aside><footer>(c)</footer>"""


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "v", PAGE), (None, "w", "<p>" + "word " * 9000)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert rows[1].text == rows[4].text == "Head & line First bold words. Be." and rows[1].n_chars == 33
    assert rows[2].text == rows[3].text == "" and rows[None].n_chars == 9000 * 5 - 1
    assert html_text.extract(pages.limit(0)).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], "x") for i in range(350)]
    rows += [(400, None, "x"), (500, [0.0] * 8, "x"), (600, [float("nan")] * 8, "x"), (601, [None] * 8, "x"), (700, rows[7][1], "x"), (None, rows[1][1], "x"), (701, [1.0, 2.0], "x"), (5, rows[5][1], "x")]
    rows += [(801, rows[100][1], "x"), (802, rows[100][1], "x")]  # equal distances
    table = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(table).collect()}
    usable = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and i not in (400, 500, 600, 601, 701)}
    for q in (0, 100, 200, 300, 700):
        want = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        assert [got[q, k + 1][0] for k in range(10)] == [i for _, i in want]
        assert np.allclose([got[q, k + 1][1] for k in range(10)], [d for d, _ in want])
    assert {q for q, _ in got} == {0, 100, 200, 300, 700}
    assert neighbours.nearest(table.limit(0)).collect() == []


def test_packing(docs, empty):
    rows = packing.pack(docs, capacities=(32, 64, 128)).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        assert len({r.bin_capacity for r in own}) == 1
        filled = sum(r.n_tokens for r in own)
        assert filled <= own[0].bin_capacity and own[0].bin_capacity == min(c for c in (32, 64, 128) if c >= filled)
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
    assert sorted(bins) == list(range(len(bins)))
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert all(tokens[i] == (len((t or "").split()) + 1) * (2 if i == 60 else 1) for i, t in texts().items())
    assert packing.pack(empty).collect() == []


def best_fit_by_hand(pieces, capacity):
    rooms = []
    for n in sorted(pieces, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    for seed in range(150):
        rng = random.Random(seed)
        pieces = [rng.randint(1, rng.choice((40, 100))) for _ in range(rng.choice((5, 60, 700)))]
        histogram = {n: pieces.count(n) for n in set(pieces)}
        made = packing.plan(histogram, (100,))
        rooms = sorted(100 - sum(k * n for k, n in held) for _, bins, held in made for _ in range(bins))
        assert rooms == best_fit_by_hand(pieces, 100)
        joint = packing.plan(histogram, (20, 50, 100))
        filled = {}
        for capacity, bins, held in joint:
            used = sum(k * n for k, n in held)
            assert used <= capacity and capacity == min(c for c in (20, 50, 100) if c >= used)
            for k, n in held:
                filled[k] = filled.get(k, 0) + n * bins
        assert filled == histogram
        cost = [sum((packing.FIXED_COST + c) * bins for c, bins, _ in some) for some in (joint, made)]
        assert cost[0] <= cost[1]


@pytest.mark.parametrize("capacity", [100_000, 3])
def test_exact_dedup(docs, empty, capacity):
    rows = exact_dedup.exact_duplicates(docs, capacity=capacity).collect()
    groups = {}
    for i, t in [*texts().items(), (60, texts()[60])]:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            norm = "".join((texts()[r.doc_id] or "").split())
            keep = min(groups[norm])[1]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[norm]), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.exact_duplicates(empty).collect() == []


def test_directory_doubles():
    counts = {k: 10 for k in range(0, 4096, 64)} | {1: 5, 2: 5}
    slots = exact_dedup.split(counts, 12, 100)
    deep = len(slots).bit_length() - 1
    held = {}
    for k, n in counts.items():
        held[slots[k >> 12 - deep]] = held.get(slots[k >> 12 - deep], 0) + n
    assert max(held.values()) <= 100 and sum(held.values()) == sum(counts.values())
    assert slots == sorted(slots) and set(slots) == set(range(max(slots) + 1))  # a bucket owns a range of keys
    assert exact_dedup.split({}, 4, 5) == [0] and exact_dedup.split({3: 9}, 2, 5) == [0, 0, 1, 2]


def test_directory_tells_crowded_prefixes_apart(spark):
    close = [(7 << 40) + k for k in range(60)]  # alike in more bits than the directory may have
    keys = spark.createDataFrame([(k,) for k in [*close, *(h << 50 for h in range(-4000, 4000))]], "h long")
    slots = exact_dedup.directory(keys, 20)
    assert len(slots) <= 1 << exact_dedup.MOST_DEPTH and len(set(slots)) >= 8000 // 20


def test_licences(spark):
    files = [(1, "/a/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", True), (2, "/a/b/x", "code", False), (3, "/a/b/y", "code\nLicensed under the Apache License, Version 2.0.", False),
             (4, "/c/z", None, False), (5, None, "", None), (None, "/a/w", "Released under the MIT License.", False), (6, "/a/b/c/v", "our licence fee is due", False)]
    table = spark.createDataFrame(files, "doc_id long, p string, text string, l boolean")
    got = {r.doc_id: (r.licence, r.origin, r.from_id) for r in licences.scan(table, table.p, table.l).collect()}
    assert got == {1: ("MIT", "own", 1), 2: ("MIT", "inherited", 1), 3: ("Apache-2.0", "own", 3), 4: (None, "none", None), 5: (None, "none", None), None: ("MIT", "inherited", 1), 6: ("MIT", "inherited", 1)}
    assert licences.scan(table.limit(0), table.p, table.l).collect() == []


def test_bpe_like_the_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Coder(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    some = ["".join(rng.choice(" \n\t'sstrevelmd  ab1²Ⅷé 　日本!?.,\0🙂") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    some += ["'" * 300, "a" * 2000, " " * 500, "x'll've'd", "I'm 'store 's", "", "it's\n\n  'tis"]
    for text, (_, _, ids, said) in zip(some, bpe.encoded(own, some), strict=True):
        want = library.encode_ordinary(text)
        assert ids.tolist() == want and said == ",".join(map(str, want)) and own.decode(ids) == text.encode()
    for r in bpe.encode_texts(docs, path, with_ids=True).collect():
        text = texts().get(r.doc_id, "nobody's text") or ""
        want = library.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_texts(empty, path).collect() == []


def as_read(spark, rows, where):
    """Documents as files, as the stages take them."""
    made = [(i, t, lang, "s", None if t is None else len(t), "more") for i, t, lang in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{where}/documents.parquet")
    return spark.read.parquet(f"{where}/documents.parquet")


def test_pipeline_stages_judge_rows(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    rows = [(i, t, "en") for i, t in texts().items()] + [(60, texts()[60], "en"), (None, "nobody's text here", "en"), (None, "another text of nobody", None), (None, "nobody's text here", "en")]
    docs = as_read(spark, rows, tmp_path)
    assert set(stages["language"](spark, docs, "").columns) == set(corpus_pipeline.COLUMNS)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i or 0))
    kept = stages["exact_copies"](spark, docs, "").collect()
    best = sorted(min(g)[1:] for g in groups.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == best  # one row of each group, also of repeated and null ids
    four = stages["repeated_passages"](spark, docs, "").collect()
    assert len(four) == len(rows) and next(r for r in four if r.doc_id == 1).text is None
    assert next(r for r in four if r.doc_id == 11).text == "other" and next(r for r in four if r.doc_id == 11).n_chars == 5
    assert sorted(r.text for r in four if r.doc_id is None) == sorted(t for i, t, _ in rows if i is None)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Coder(public_tokenizers.path(corpus_pipeline.VOCABULARY)).ranks, special_tokens={})
    want, got = {}, {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len(library.encode_ordinary(t or "")) + 1
    packed = stages["packing"](spark, docs, "").collect()
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert r.bin_offset + r.n_tokens <= r.bin_capacity
    assert got == want


def test_pipeline_runs_and_takes_nothing(spark, tmp_path):
    rows = [(i, t, "en") for i, t in texts().items()] + [(None, "x gamma omega alpha " * 4, None)]
    as_read(spark, rows, tmp_path / "some")
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert out and {r.doc_id for r in out} <= {i for i, _, _ in rows} and None in {r.doc_id for r in out} and not {1, 2, 3, 5} & {r.doc_id for r in out}
    as_read(spark, [], tmp_path / "none")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_session_settings_stay(spark, docs):
    before = dict(r for r in spark.conf.getAll.items() if r[0].startswith("spark.sql"))
    for df in (simhash.near_duplicates(docs), neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")), bpe.encode_texts(docs, public_tokenizers.path(corpus_pipeline.VOCABULARY))):
        df.count()
    assert {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")} == before


def test_exact_sql(spark, tmp_path, docs):
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/d")
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql(exact_dedup.ORACLE_SQL).fetchall()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == want
