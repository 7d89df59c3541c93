import random
import re

import numpy as np
import xxhash

from semilog.llm import simhash
from semilog.llm.components import smallest_reachable
from tests.llm.tables import documents, rows_by_id


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_labels(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints():
    r = random.Random(1)
    texts = ["", " \t\n", "A B", "one two three four", "İ \x85 x \x1c z é"] + [" ".join(r.choice("abcdeé") for _ in range(r.randrange(40))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def near_fingerprints(n, seed=2):
    r = np.random.default_rng(seed)
    fps = r.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(n // 2):
        flips = sum(1 << int(b) for b in r.choice(64, r.integers(1, 7), replace=False))
        fps[n - 1 - i] = fps[r.integers(0, n // 2)] ^ np.uint64(flips)
    return np.unique(fps)


def brute_pairs(fps, radius):
    return [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= radius]]


def test_tiles_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    monkeypatch.setattr(simhash, "TILE_COLUMNS", 16)
    fps = near_fingerprints(400)
    nodes = [int(x) for x in fps]
    for at_once in (len(fps), 37):  # all others together, and in passing
        linker, found = simhash.Linker(fps), []
        for at in range(0, len(fps), at_once):
            a, b = linker.meet(fps[at : at + at_once])
            assert len(a) <= at_once
            found += zip(a.tolist(), b.tolist())
        a, b = linker.between_own()
        found += zip(a.tolist(), b.tolist())
        assert component_labels(nodes, found) == component_labels(nodes, brute_pairs(fps, 4))


def test_cells_lose_no_link(spark):
    fps = near_fingerprints(600, 3)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for rows, at_once in ((10**6, 10**6), (7, 5)):  # one part for each cell and all others held, and several parts and few others
        found = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.near_pairs(df, cell_rows=rows, at_once=at_once).collect()]
        nodes = [int(x) for x in fps]
        assert component_labels(nodes, found) == component_labels(nodes, brute_pairs(fps, 4))


def test_a_tight_group_emits_no_pairs(spark):
    base = 0x0F0F0F0F0F0F0F0F
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert links.count() < 30 * len(fps)
    assert {r.v for r in smallest_reachable(links).collect()} == {min(signed)}


def test_components_of_chains(spark):
    r = random.Random(5)
    order = list(range(60))
    r.shuffle(order)
    pairs = list(zip(order, order[1:]))[:30] + [(100, 101), (101, 102), (7, 7)] + list(zip(order, order[1:]))[31:]
    got = {x.u: x.v for x in smallest_reachable(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = component_labels(sorted({n for p in pairs for n in p}), pairs)
    assert got == {n: c for n, c in want.items() if n != c}
    assert smallest_reachable(spark.createDataFrame([], "u long, v long")).collect() == []


def texts():
    r = random.Random(7)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(40)) for _ in range(120)) for _ in range(12)]
    out = []
    for t in base:
        words = t.split()
        out += [t, t.upper(), " ".join(words[:-1]), " ".join([*words[:60], "zzz", *words[60:]])]
    return [None, "", "x", "X", *out]


def test_query(spark):
    own = texts()
    ids = random.Random(8).sample(range(1000), len(own))
    fps = [brute_fingerprint(t or "") for t in own]
    pairs = [(ids[i], ids[j]) for i in range(len(own)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = component_labels(sorted(ids), pairs)
    got = rows_by_id(simhash.report(documents(spark, own, ids)))
    for i, fp in zip(ids, fps):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == want[i]


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(r.doc_id, r.component_id) for r in simhash.report(documents(spark, ["a b", "a b", "a b", "q", ""], [3, 3, None, None, 9])).collect()]
    assert sorted(rows, key=str) == sorted([(3, 3), (3, 3), (None, 3), (None, None), (9, 9)], key=str)
    assert simhash.report(documents(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    docs = documents(spark, ["a b c d e f", "A B C D E F", "other words here now", None, "", "null id"], [5, 2, 7, 8, 4, None]).selectExpr("*", "1 as component_id", "2 as fp")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, 7, None]
