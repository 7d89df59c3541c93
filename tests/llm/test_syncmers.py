import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from semilog.llm import syncmers
from tests.llm.tables import documents, rows_by_id


def ordered(texts, ids):
    """Indexes by descending id (null last), then text."""
    return sorted(range(len(texts)), key=lambda i: (ids[i] is None, -(ids[i] or 0), texts[i] or ""))


def edited(texts, ids):
    order, out = ordered(texts, ids), {}
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        m = len(text) // 3
        out[i] = text[: len(text) - m] + following[:m]
    return out


def words(r, n):
    return " ".join(r.choice(["an", "thé", "re", "ti", "🎉", "or"]) + r.choice(["", "on", "ing"]) + str(r.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    r = random.Random(3)
    texts = [None, "", "x", "short text here"] + [words(r, r.choice([3, 10, 30, 80, 200])) for _ in range(60)] + [words(r, 5000)]
    texts += [texts[20], texts[20]]
    return texts, r.sample(range(-50, 5000), len(texts))


def test_edits(spark, case, monkeypatch):
    texts, ids = case
    want = edited(texts, ids)
    for rows in (1000, 5):  # one bucket, and many
        monkeypatch.setattr(syncmers, "BUCKET_ROWS", rows)
        got = rows_by_id(syncmers.report(documents(spark, texts, ids)))
        for i, text in enumerate(texts):
            row = got[ids[i]]
            assert row.n_chars == len(text or "") and row.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()


def brute_anchors(h, s):
    """(place, hash of the run's parts) of the closed syncmers, from the hashes of units and of pairs."""
    return [i for i in range(len(h) - syncmers.K + 1) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]


def read_back(fingerprint):
    """(place, hash) of every anchor of a fingerprint."""
    out, at = [], -1
    for i in range(0, len(fingerprint), 9):
        at += int(fingerprint[i], 16)
        out.append((at, fingerprint[i + 1 : i + 9]))
    return out


def brute_likeness(a, b):
    """Share of common (anchor before, distance, anchor), each counted once."""

    def steps(fingerprint):
        anchors = [(-1, "")] + read_back(fingerprint)
        return {(x[1], y[0] - x[0], y[1]) for x, y in zip(anchors, anchors[1:])}

    a, b = steps(a), steps(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness(spark, case):
    texts, ids = case
    got = rows_by_id(syncmers.report(documents(spark, texts, ids)))
    order = ordered(texts, ids)
    near = []
    for at, i in enumerate(order):
        row, after = got[ids[i]], got[ids[order[(at + 1) % len(order)]]]
        assert row.near_edited == pytest.approx(brute_likeness(row.fingerprint, row.edited_fingerprint))
        assert row.near_next == pytest.approx(brute_likeness(row.fingerprint, after.fingerprint))
        if len((texts[i] or "").split()) >= 10:
            near.append(row.near_edited > 0.2 > row.near_next or texts[i] == texts[order[(at + 1) % len(order)]])
    assert sum(near) / len(near) > 0.95
    assert got[ids[-1]].fingerprint == got[ids[20]].fingerprint == got[ids[-2]].fingerprint
    assert len({got[i].fingerprint for i in ids[2:40]}) == 38 and got[ids[0]].fingerprint == got[ids[1]].fingerprint == ""


def test_anchors_are_closed_syncmers(spark):
    df = spark.createDataFrame([(words(random.Random(9), 60),), ("",), ("a b",)], "t string")
    rows = syncmers.with_anchors(syncmers.with_hashes(df, "t", "h", "s"), "t", "a").collect()
    for row in rows:
        assert [a.pos for a in row.a] == brute_anchors(row.h, row.s)
    assert len(rows[0].h) == 68 and rows[1].a == [] and len(rows[2].a) >= 2
    told = syncmers.with_fingerprint(df, "t", "f").select(syncmers.told("f").alias("f")).collect()
    assert [read_back(x.f) for x in told] == [[(a.pos, f"{a.hash:08x}") for a in row.a] for row in rows]


def test_anchors_hang_on_nothing_around_them(spark):
    r = random.Random(10)
    middle = words(r, 100)
    df = spark.createDataFrame([(words(r, 40) + " " + middle + " " + words(r, 40),), (words(r, 25) + " " + middle,)], "t string")
    a, b = ({x.hash for x in row.a} for row in syncmers.with_anchors(df, "t", "a").collect())
    alone = syncmers.with_anchors(spark.createDataFrame([(middle,)], "t string"), "t", "a").collect()[0].a
    inside = {x.hash for x in alone if 4 <= x.pos < 100}  # runs without a border
    assert len(inside) > 40 and inside <= a and inside <= b


@pytest.mark.parametrize("n", [8, 20, 23, 24, 26, 30, 200])
def test_texts_of_all_lengths_are_compared_alike(spark, n):
    r = random.Random(11)
    long = words(r, n)
    shorter = " ".join(long.split()[:-1])
    got = rows_by_id(syncmers.report(documents(spark, [long, shorter, "x", long], [4, 3, 2, 1])))
    assert got[4].near_next > 0.3  # the text and itself without its last word
    assert got[1].near_edited > 0.15 and got[2].near_next == 0


def test_a_shared_passage_of_long_texts_is_seen(spark):
    r = random.Random(12)
    passage = words(r, 300)
    texts = [words(r, 3000) + " " + passage, passage + " " + words(r, 3000), words(r, 3000)]
    got = rows_by_id(syncmers.report(documents(spark, texts, [3, 2, 1])))
    assert 0.03 < got[3].near_next < 0.07 and got[2].near_next < 0.005


def test_every_text_with_a_word_has_anchors_and_all_are_told(spark):
    r = random.Random(12)
    texts = [words(r, n) for n in range(1, 40)] + ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    for row in syncmers.report(documents(spark, texts)).collect():
        assert re.fullmatch("([1-3][0-9a-f]{8})+", row.fingerprint)
        n = len(texts[row.doc_id].split())
        assert read_back(row.fingerprint)[-1][0] >= n + 1  # the last anchor lies within the border behind


@pytest.mark.parametrize("texts, ids", [(["only one text"], [5]), (["a b", "c d e", "c d e"], [1, 1, 1]), (["abc", "defg", None, "hi"], [None, 3, None, 3])])
def test_ties_and_nulls(spark, texts, ids):
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in edited(texts, ids).values())
    assert sorted(r.edited_sha256 for r in syncmers.report(documents(spark, texts, ids)).collect()) == want


def test_native_plan_and_empty_table(spark):
    df = syncmers.report(documents(spark, ["a b c", "d e f"]))
    assert not re.search("Python|Pandas|ArrowEval|MapIn", df._jdf.queryExecution().executedPlan().toString())
    assert syncmers.report(documents(spark, [])).collect() == []
    docs = documents(spark, ["a b c"]).select("*", F.lit(1).alias("bucket"), F.lit(2).alias("key"), F.lit(3).alias("own"))
    assert syncmers.report(docs).count() == 1
