import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from semilog.llm import bpe
from semilog.llm.common import tokenizer_file
from tests.llm.tables import documents, rows_by_id

PATH = tokenizer_file("word_bpe_49k.json")
ODD = ["", " ", "it's ''s don't I'LL a''sb <|endoftext|>x <|startoftext|><|endoftext|>", "ΑΣ İstanbul ﬁ x\x1cy é ́ a", "a" * 300 + " " + "ab" * 3000, "日本語テキスト 12345 ①② 🎉🎉  ​﻿", "\x85a\x00b c\x1f\x1e", "<|endoftext|", "Ǆ ẞ ΟΔΟΣ Σ"]


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(own, library, texts):
    for text, packed in zip(texts, own.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text[:80]
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(own, library):
    same(own, library, ODD)


def test_random_texts(own, library):
    r = random.Random(1)
    pick = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x600), r.randrange(0x1E00, 0x3100), 32]))
    same(own, library, ["".join(pick() for _ in range(r.randrange(80))) for _ in range(500)])


def test_no_token_joins_a_cut(own):
    assert not own.joined[ord("a"), ord(" ")] and own.joined[ord("t"), ord("h")]


def test_caches_that_overflow(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    for _ in range(3):
        same(own, library, ["one two three four five", "six seven one"])


def test_query(spark, library):
    texts = [None, *ODD, ODD[2]]
    got = rows_by_id(bpe.digests(documents(spark, texts)))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got[i]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_and_empty_tables(spark):
    docs = documents(spark, ["a b"]).selectExpr("*", "1 as ids", "2 as N_TOKENS")
    made = bpe.encode(docs)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    assert [r.decoded for r in bpe.decode(made).collect()] == ["a</w> b</w>"]
    assert bpe.digests(documents(spark, [])).collect() == []
