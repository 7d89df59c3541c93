import random

import numpy as np

import corpus_pipeline
from semilog.llm import near
from tests.llm.tables import documents
from tests.llm.test_simhash import brute_fingerprint, component_labels


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return not (a or b) or len(a & b) / len(a | b) >= 0.8


def corpus():
    r = random.Random(4)
    out = [None, "", "few words", "Few  words", "few word"]
    line = " ".join(f"line{i}" for i in range(30))  # many texts share it
    for t in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([40, 300]))]
        for edits in (0, 1, 3, 5, 6, 8, 12):
            own = list(words)
            for at in r.sample(range(len(own)), min(edits, len(own) // 10)):
                own[at] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(own) + (" " + line if t % 2 else ""))
    return out


def test_every_similar_pair_is_linked(spark):
    texts = corpus()
    ids = random.Random(5).sample(range(1000), len(texts))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j])]
    far = [(i, j) for i, j in pairs if (brute_fingerprint(texts[i] or "", 5) ^ brute_fingerprint(texts[j] or "", 5)).bit_count() > corpus_pipeline.NEAR_BITS]
    assert far  # pairs that the fingerprints alone don't link
    want = set(component_labels(ids, [(ids[i], ids[j]) for i, j in pairs]).values())
    got = corpus_pipeline.near_dedup_stage(spark, documents(spark, texts, ids), "")
    assert {r.doc_id for r in got.collect()} == want


def test_parities_drop_no_similar_pair():
    """What parities tell is never more than the shingles that two sets don't share."""
    texts = corpus()
    sets = [near.shingle_set(t or "") for t in texts]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            differing = len(np.setxor1d(a, b))
            assert near.apart(near.parity(a), near.parity(b)) <= differing
            assert near.apart(near.parity(a, 512), near.parity(b, 512)) <= differing


def test_nulls_and_empty_tables(spark):
    docs = documents(spark, ["a b c d e f", "A B C D E F", "other words", None, "", "null id", "null id"], [5, 2, 7, 8, 4, None, None])
    assert sorted((r.doc_id for r in near.keep_one(docs).collect()), key=str) == [2, 4, 7, None, None]
    assert near.keep_one(documents(spark, [])).collect() == []
