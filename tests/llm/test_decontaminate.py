import random
from collections import Counter

import numpy as np
import pytest

from semilog.llm import decontaminate as d
from tests.llm.tables import documents


def prose(r, n):
    return " ".join(r.choice(["an", "the", "re", "ti", "en", "or", "le", "st", "ha", "we"]) + r.choice(["", "on", "ing", "ed", "er"]) + str(r.randrange(60)) for _ in range(n))


def benchmark(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def brute(texts, items):
    """Documents and items with some item-sized window that is similar enough."""
    out = set()
    for i, text in enumerate(texts):
        words = d.words_of(text or "")
        for j, item in enumerate(items):
            own = d.words_of(item or "")
            k, size = min(5, len(own)), min(len(own), len(words))
            if own and size >= k:
                want = Counter(d.shingles(own, k))
                if max(d.weighted_similarity(Counter(d.shingles(words[s : s + size], k)), want) for s in range(len(words) - size + 1)) >= 0.8:
                    out.add((i, j))
    return out


def case():
    r = random.Random(4)
    items = [prose(r, n) for n in (12, 20, 20, 37, 60)] + ["one two three", "", None, "word " * 8]
    texts = [prose(r, 200) for _ in range(6)]
    texts += [f"{prose(r, 50)}\n{item} {prose(r, 50)}" for item in items[:5]]
    texts += [f"{prose(r, 20)}, {items[3].upper().replace(' ', ', ')}!! {prose(r, 20)}"]  # case and marks
    words = items[4].split()
    texts += [" ".join([*words[:30], "changed", *words[31:]])]  # one word of 60 changed
    texts += [" ".join([*words[:20], "x", *words[21:40], "y", *words[41:]])]  # two: below the threshold
    texts += [" ".join(words[:52]), " ".join(words[:30])]  # a part of an item
    texts += [None, "", "say one two three now", "word " * 500, items[0] + " " + items[0]]
    return texts, items


def test_query_is_brute_force(spark):
    texts, items = case()
    found = d.report(documents(spark, texts), benchmark(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(texts, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    for r in found:
        assert r.similarity >= 0.8 and len(d.words_of(texts[r.doc_id][r.start_char : r.end_char])) == r.n_words
        if r.doc_id in range(6, 11):
            assert r.differing_bits == 0 and r.similarity == 1.0 and texts[r.doc_id][r.start_char : r.end_char] == items[r.item_id]


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    queries = np.array([fps[i % 60] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, i % 20, replace=False))) for i in range(200)], np.uint64)
    want = {(q, i) for q in range(200) for i in range(60) if int(queries[q] ^ fps[i]).bit_count() <= d.RADIUS}
    assert {(q, i) for q, i, _ in d.HammingIndex(fps, d.RADIUS).near(queries)} == want


def test_window_fingerprints():
    words = prose(random.Random(2), 40).split()
    votes = d.bits_of(d.shingles(words, 5))
    for s, fp in enumerate(d.fingerprints(votes, 10).tolist()):
        assert fp == int("".join("1" if 2 * v > 10 else "0" for v in votes[s : s + 10].sum(0)), 2)


def test_parts_of_the_benchmark(spark):
    texts, items = case()
    whole = d.report(documents(spark, texts), benchmark(spark, items)).collect()
    parts = d.find(documents(spark, texts), benchmark(spark, items), part_chars=200).collect()
    assert sorted(whole) == sorted(parts)


def test_clean_documents_stay(spark):
    texts, items = case()
    docs = documents(spark, texts).selectExpr("*", "1 as m", "2 as item_id")
    leaked = {i for i, _ in brute(texts, items)}
    kept = d.keep_clean(docs, benchmark(spark, items))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in leaked]


@pytest.mark.parametrize("texts, items", [([], ["a b c d e f"]), (["a b c d e f"], []), ([None], [None])])
def test_empty_tables(spark, texts, items):
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    assert d.report(documents(spark, texts), bench).collect() == []
    assert d.keep_clean(documents(spark, texts), bench).count() == len(texts)


def test_edited_passages_stay_within_the_radius():
    r, pairs, far = random.Random(9), 0, 0
    while pairs < 2000:
        words = prose(r, r.choice([30, 60, 120, 200])).split()
        edited = list(words)
        for _ in range(r.randint(1, max(1, len(words) // 45))):
            edited[r.randrange(len(edited))] = "other"
        a, b = d.shingles(words, 5), d.shingles(edited, 5)
        if d.weighted_similarity(Counter(a), Counter(b)) >= d.SIMILARITY:
            x, y = (int(d.fingerprints(d.bits_of(s), len(s))[0]) for s in (a, b))
            pairs, far = pairs + 1, far + ((x ^ y).bit_count() > d.RADIUS)
    assert far <= 2
