"""The pipeline against each operator's brute force, stage by stage, on whole small tables."""

import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from semilog.llm import decontaminate, pii
from semilog.llm.common import materialise, tokenizer_file
from tests.llm.test_decontaminate import brute
from tests.llm.tables import documents
from tests.llm.test_near import alike
from tests.llm.test_simhash import component_labels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "stage"))
    return out


def frame(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def test_columns_stay_until_the_last(stages):
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(frame(stages[1]).doc_id)
    good, bad = (set(labels.index[labels == q]) for q in (1, 0))
    assert len(good & kept) / len(good) > 0.95 and len(bad & kept) / len(bad) < 0.3


def test_one_of_each_group(stages):
    docs = frame(stages[1])
    pairs = [(docs.doc_id[i], docs.doc_id[j]) for i in range(len(docs)) for j in range(i) if alike(docs.text[i], docs.text[j])]
    want = sorted({int(c) for c in component_labels(docs.doc_id.tolist(), pairs).values()})
    assert frame(stages[2]).doc_id.tolist() == want


def test_benchmark_passages_go(spark, stages):
    docs = frame(stages[2])
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text.tolist()
    leaked = {docs.doc_id[i] for i, _ in brute(docs.text.tolist(), items)}
    assert frame(stages[3]).doc_id.tolist() == [i for i in docs.doc_id if i not in leaked]


def test_personal_data_goes(stages):
    before, after = frame(stages[3]), frame(stages[4])
    assert before.doc_id.tolist() == after.doc_id.tolist()
    for a, b in zip(before.itertuples(), after.itertuples()):
        spans = pii.base_spans(a.text)
        assert (a.text == b.text) == (not pii.selector().spans([a.text])[1][0]) and b.n_chars == len(b.text)
        assert not pii.base_spans(b.text) or not spans


def test_ids_are_the_library_s(stages):
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for row in frame(stages[5]).itertuples():
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert list(memoryview(row.ids).cast("I")) == ids and row.n_tokens == len(ids)


def test_run_is_the_stages(spark, stages):
    got, want = frame(corpus_pipeline.run(spark, SF)), frame(stages[-1])
    pd.testing.assert_frame_equal(got, want)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert decontaminate.SIMILARITY == 0.8


def test_odd_rows_and_columns(spark):
    """Nulls, empty and very long texts, repeated rows and columns named like a stage's own go through every stage."""
    whole = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text[0]
    good = whole.text[:3].tolist()
    long = " ".join(f"{w}{i}" for i, w in enumerate((good[0].split() * 9000)[:60_000]))
    texts = [None, "", good[0], good[0], f"{good[1]} {item} {good[2]}", long, f"write to some.one@mail.example.org about {good[1]}"]
    rows = documents(spark, texts, [None, 1, 2, 2, 4, 5, 6]).selectExpr("*", "1 as _clean", "2 as score", "3 as _kept_score", "4 as key", "5 as fp", "6 as spans", "7 as ids", "8 as _id")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        got = out.collect()
        if at < 4:
            assert out.schema.simpleString() == rows.schema.simpleString()
            assert {(r._clean, r.score, r._kept_score, r.key, r.fp, r.spans, r["ids"], r._id) for r in got} <= {(1, 2, 3, 4, 5, 6, 7, 8)}
        ids = sorted((r.doc_id for r in got), key=str)
        if at == 1:
            assert ids == [1, 2, 2, 4, 5, 6, None]
        elif at == 2:
            assert ids == [1, 2, 2, 5, 6, None]
        elif at > 2:
            assert len(ids) == 7
        if at == 3:
            by_id = {r.doc_id: r.text for r in got}
            assert by_id[None] is None and by_id[1] == "" and by_id[5] == long and "<EMAIL> about" in by_id[6]
        if at == 4:
            library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
            assert {r.doc_id: r.n_tokens for r in got}[5] == len(library.encode(long, add_special_tokens=False).ids)


def test_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).collect() == []
