import random
import zlib

import numpy as np

from semilog.llm import quality
from tests.llm.tables import documents, rows_by_id


def table(name):
    return f"/root/testdata/sf0.01/{name}.parquet"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def area(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(table("documents")), spark.read.parquet(table("labels"))
    got = rows_by_id(quality.report(docs, labels))
    assert len(got) == docs.count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    pairs = [(got[r.doc_id].score, r.quality, got[r.doc_id].predicted) for r in labels.collect() if held(r.doc_id)]
    scores, y, predicted = map(np.array, zip(*pairs))
    assert area(scores, y) > 0.97 and (predicted == y).mean() > 0.93
    again = rows_by_id(quality.report(docs.repartition(5), labels))
    assert all(abs(again[i].score - got[i].score) < 1e-6 for i in got)  # however the rows are dealt


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(table("documents")), spark.read.parquet(table("labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    one, two = (rows_by_id(quality.report(docs, x)) for x in (labels, flipped))
    assert all(one[i].score == two[i].score for i in one)


def small(spark, n=60):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "over", "stones", "and", "moss"]) for _ in range(30)) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "$$$", "###", "WIN!!"]) for _ in range(30))
    docs = documents(spark, [None, ""] + [(good, bad)[i % 2]() for i in range(n)] + ["word " * 50000])
    labels = spark.createDataFrame([(i + 2, 1 - i % 2, 0) for i in range(n)] + [(None, 1, 0), (5, None, None), (2, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_stage_keeps_good_rows(spark):
    docs, labels = small(spark)
    docs = docs.selectExpr("*", "7 as score", "8 as label")
    kept = quality.keep_good(docs, labels)
    assert sorted(kept.columns) == sorted(docs.columns)
    rows = kept.collect()
    ids = {r.doc_id for r in rows}
    assert all(r.score == 7 for r in rows) and all((i + 2 in ids) == (i % 2 == 0) for i in range(60))


def test_without_labels_and_without_rows(spark):
    docs, labels = small(spark)
    assert {r.score for r in quality.report(docs, labels.where("false")).collect()} == {0.5}
    assert quality.report(docs.where("false"), labels).collect() == []
    assert quality.report(documents(spark, ["x", "x"], [None, None]), labels).count() == 2


def test_sample_is_bounded(spark):
    docs, labels = small(spark)
    vectors = quality.word_vectors(docs)
    model = quality.train(docs, labels, vectors, sample=10)
    assert isinstance(model, quality.Network | quality.Constant)


def test_contexts_by_hand():
    texts = ["aa bb aa", "cc", "", "bb aa"]
    got = quality.contexts(texts)
    places, signs = quality.index_vectors()
    want = np.zeros_like(got)
    for text in texts:
        pairs = [quality.word_pair(w) for w in text.split()]
        words = [(p // quality.SHAPES, quality.SHAPES - 1 if i and pairs[i - 1] == p else p % quality.SHAPES) for i, p in enumerate(pairs)]
        for i, (letters, shape) in enumerate(words):
            want[letters, -1] += 1
            want[shape, -1] += 1
            for j, (l2, s2) in enumerate(words):
                if i != j and abs(i - j) <= quality.REACH:
                    for row, seen in ((letters, l2), (letters, s2), (shape, s2)):
                        for k in range(quality.NONZERO):
                            want[row, places[seen, k]] += signs[seen, k]
    assert (got == want).all()
