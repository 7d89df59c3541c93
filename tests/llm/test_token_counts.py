import pytest
from tokenizers import Tokenizer

from semilog.llm import token_counts
from semilog.llm.common import scratch, tokenizer_file
from tests.llm.tables import documents, rows_by_id

TEXTS = [None, "", "the same text", "the same text", "an <|endoftext|> inside", "İ \x1c ſ 日本語 🎉", " " * 700 + "x", "tab\tand  spaces\n\n", "word " * 20000]


def exact(text, name="byte_bpe_50k.json"):
    return len(Tokenizer.from_file(tokenizer_file(name)).encode(text or "", add_special_tokens=False).ids)


def test_query(spark):
    got = rows_by_id(token_counts.counts(documents(spark, TEXTS)))
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n = exact(text)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512), text


def test_quick_path_is_the_library(spark):
    """Every character that takes the quick path, alone and around spaces."""
    texts = []
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), *range(0x3041, 0x3097), *range(0x4E00, 0x4F00)]):
        if not token_counts.UNCOMMON.search(c):
            texts.append(f"a{c}b {c}{c} 1{c}2{c}")
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_counts.counter(tokenizer_file("byte_bpe_50k.json"))(texts) == want


def test_only_misses_are_encoded(spark):
    path = scratch(spark, "cache")
    token_counts.count_tokens(documents(spark, ["a b", "c", "a b"]), path).collect()
    assert spark.read.parquet(path).count() == 2
    again = token_counts.count_tokens(documents(spark, ["a b", "d e f", None]), path)
    assert {r.doc_id: r.n_tokens for r in again.collect()} == {0: exact("a b"), 1: exact("d e f"), 2: 0}
    assert spark.read.parquet(path).count() == 4
    # another tokenizer's counts are other entries
    other = token_counts.count_tokens(documents(spark, ["a b"]), path, vocabulary="word_bpe_49k.json")
    assert other.collect()[0].n_tokens == exact("a b", "word_bpe_49k.json")
    assert spark.read.parquet(path).count() == 5


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = token_counts.count_tokens(documents(spark, ["some text"]), scratch(spark, "cache"), vocabulary="piece_bpe_32k.model").collect()
    assert got[0].n_tokens == len(model.encode("some text"))


@pytest.mark.parametrize("ids", [[1, 1, None, None]])
def test_repeated_and_null_ids(spark, ids):
    docs = documents(spark, ["x", "x", "y z", "y z"], ids)
    rows = [(r.doc_id, r.n_tokens) for r in token_counts.counts(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (1, 1), (None, exact("y z")), (None, exact("y z"))], key=str)
    path, key = scratch(spark, "cache"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # as on tables whose missing ids are no broadcast's size
    try:
        assert token_counts.count_tokens(docs, path).count() == 4
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(path).count() == 2  # one count for each content
    assert token_counts.counts(documents(spark, [])).collect() == []
    named = documents(spark, ["x"]).selectExpr("*", "1 as content", "2 as n_tokens", "3 as id", "4 as n_bytes")
    assert token_counts.counts(named).collect()[0].n_tokens == 1
