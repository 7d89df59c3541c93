"""Token counts through a digest cache.

A text's count depends on its content and on the tokenizer's version alone. Both are digested; counts found in
the cache under that pair are taken from there, each distinct missing content is encoded once, and its count is
appended to the cache (a Parquet table in a folder that all executors share).

The content that is digested is the text with null as the empty text: byte-level tokenizers tell all other
texts apart, so any further normalisation would change counts.

Plan: one scan writes the narrow table (id, content digest, bytes). The distinct digests without a stored count
are found on narrow rows, where a group of copies is pre-aggregated before the shuffle. Only then are texts moved,
dealt by document id and content, and each missing content is encoded in one place: rows that repeat an id (or have
none) and a text meet in one task, which encodes the first of them. Where the missing ids' written size is below Spark's
threshold for a broadcast, texts stay where they are, and such rows are encoded once in each task that has one. The last join is narrow too; a content
that many documents share is split by Spark's skew join.

Defined results: a null text has 0 bytes and the count of the empty text; rows that repeat (id and text) repeat in
the result; an empty table gives an empty table; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semilog.llm.common import exists, give_back, materialise, scratch, slices, texts_of, tokenizer_file

#: Characters whose classes are alike in all Unicode versions in use; other texts go to the file's own library.
UNCOMMON = re.compile("[^\x00-ɏ‐-‧ぁ-ゖァ-ヺ一-龥]|[\x1c-\x1f\x85]|\\s{500}")
SCHEMA = "content binary, tokenizer string, n_tokens long"


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to token counts, one for each file and Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    exact = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    spec = json.load(open(path, encoding="utf-8"))
    ranks = ordered_ranks(spec)
    if ranks is None:
        return exact
    import public_tokenizers
    import tiktoken

    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def count(texts: list[str]) -> list[int]:
        rare = [i for i, t in enumerate(texts) if UNCOMMON.search(t)]
        out = [0] * len(texts)
        for i, n in zip(rare, exact([texts[i] for i in rare])):
            out[i] = n
        for i in set(range(len(texts))).difference(rare):
            out[i] = len(quick.encode(texts[i], allowed_special="all"))
        return out

    return count


def ordered_ranks(spec: dict) -> dict[bytes, int] | None:
    """Rank by token, if the file is plain byte-level BPE whose ids are in merge order; None otherwise."""
    from semilog.llm.bpe import byte_symbols

    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or model.get("end_of_word_suffix") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    back = {c: b for b, c in byte_symbols().items()}
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 != len(vocab):
        return None
    return {bytes(back[c] for c in t): i for t, i in vocab.items()}


def tokenizer_digest(vocabulary: str) -> str:
    """The tokenizer's version: its file's digest."""
    return hashlib.sha256(open(tokenizer_file(vocabulary), "rb").read()).hexdigest()


def count_tokens(docs: DataFrame, cache_path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Per row of ``docs`` its id, content (digest), n_bytes and n_tokens; the cache at ``cache_path`` grows."""
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256)).alias("content")
    narrow = materialise(docs.select(F.col(id_col).alias("id"), content, F.octet_length(text).cast("long").alias("n_bytes")), "digests")

    wanted = narrow.groupBy("content").agg(F.min("id").alias("id"))
    if exists(spark, cache_path):
        wanted = wanted.join(stored(spark, cache_path, version), "content", "left_anti")
    misses = materialise(wanted, "misses")
    found = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hit = (found["id"].eqNullSafe(misses["id"])) & (F.unhex(F.sha2(found["text"].cast("binary"), 256)) == misses["content"])
    texts = found.join(misses, hit).select("content", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for run in slices(batch):
                first = {c: i for i, c in reversed(list(enumerate(run.column(0).to_pylist()))) if c not in done}
                done.update(first)
                numbers = counter(tokenizer_file(vocabulary))(texts_of(run.column(1).take(pa.array(list(first.values()), pa.int64()))))
                yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(numbers, pa.int64())], names=["content", "n_tokens"])
        give_back()

    counted = texts.mapInArrow(count, "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return narrow.join(stored(spark, cache_path, version), "content").select(F.col("id").alias(id_col), "content", "n_bytes", "n_tokens")


def stored(spark, cache_path: str, version: str) -> DataFrame:
    """One count for each content that the cache has for this tokenizer; writers at the same time may have added one twice."""
    cache = spark.read.schema(SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    return cache.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def counts(docs: DataFrame, limit: int = 512) -> DataFrame:
    """Per document bytes, tokens and whether they are over ``limit``, with a cache of this call's own."""
    made = count_tokens(docs, scratch(docs.sparkSession, "token-cache"))
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
