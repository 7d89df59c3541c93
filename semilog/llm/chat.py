"""Chat formatting by columnar byte assembly.

A batch of turns becomes one byte buffer: numpy computes the length of every segment (header, escaped text, footer),
cumulative offsets give each its place, and all segments are copied into one preallocated buffer that becomes an
Arrow string array without further copies. Turns are formatted on their own, so a conversation of any length is a
run of pieces with running offsets and never has to fit in one row; ``conversations_of`` reads the pieces back.

Template, for each turn: ``<|turn|>`` role ``<|text|>`` text ``</turn|>`` and a line feed. Control strings of this
and of common other templates inside a text or role get a backslash after their first character, and every
backslash of the text is doubled; so the escaped text has no control string and the original can be read back.

Loss mask: the text segment of every turn of the role ``assistant``.

Defined results: turns are ordered by number, then role, then text (nulls first), repeated rows included; a null
text is the empty text, a null role the empty role; rows without a conversation id form one conversation without
id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semilog.llm.common import SLICE_ROWS, slices

HEAD, MIDDLE, TAIL = "<|turn|>", "<|text|>", "</turn|>\n"
#: Control strings that a text may not have as they are.
CONTROL = ("<|turn|>", "<|text|>", "</turn|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
TO_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, sorted(CONTROL, key=len, reverse=True))]))
ESCAPED = re.compile(r"\\(\\?)")
PIECE = re.compile(re.escape(HEAD) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(TAIL), re.S)
LEARNED = "assistant"
PIECES = "conv_id long, turn long, place long, formatted string, start_chars long, text_start long, text_end long, learned boolean"


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text) if TO_ESCAPE.search(text) else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(roles: list[str], texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns, and each one's code points: where its text starts, where it ends, and in all."""
    heads = [f"{HEAD}{escape(r)}{MIDDLE}" for r in roles]
    bodies = [escape(t) for t in texts]
    segments = [s.encode() for pair in zip(heads, bodies) for s in pair]
    tail = np.frombuffer(TAIL.encode(), np.uint8)
    lengths = np.empty((len(roles), 3), np.int64)
    lengths[:, :2] = np.fromiter(map(len, segments), np.int64, len(segments)).reshape(-1, 2)
    lengths[:, 2] = len(tail)
    ends = np.cumsum(lengths.ravel()).reshape(-1, 3)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, 2]) if len(ends) else 0, np.uint8)
    source = np.frombuffer(b"".join(segments), np.uint8)
    # Source bytes lie one after the other; each moves on by the footers that stand before it.
    shift = np.repeat(np.arange(len(roles)) * len(tail), lengths[:, :2].sum(1))
    buffer[np.arange(len(source)) + shift] = source
    buffer[(starts[:, 2, None] + np.arange(len(tail))).ravel()] = np.tile(tail, len(roles))
    offsets = np.concatenate(([0], ends[:, 2])).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(roles), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).cast(pa.string())
    head_chars = np.fromiter(map(len, heads), np.int64, len(heads))
    body_chars = np.fromiter(map(len, bodies), np.int64, len(bodies))
    return array, head_chars, head_chars + body_chars, head_chars + body_chars + len(TAIL)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One piece for each turn: ``formatted`` and, in code points of its conversation, where piece and text lie.

    Rows of a conversation come together sorted, and a task walks them as a stream: it keeps one batch and the running
    offset, whatever the conversation's length.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, at = object(), 0, 0
        for whole in batches:
            for batch in slices(whole):
                ids = batch.column(0).to_pylist()
                roles = batch.column(2).to_pylist()
                made, text_start, text_end, size = assemble(roles, batch.column(3).to_pylist())
                starts, places = [], []
                for conv, n in zip(ids, size.tolist()):
                    if conv != last:
                        last, place, at = conv, 0, 0
                    starts.append(at)
                    places.append(place)
                    at, place = at + n, place + 1
                begun = np.array(starts, np.int64)
                learned = [r == LEARNED for r in roles]
                columns = [batch.column(0), batch.column(1), pa.array(places, pa.int64()), made, pa.array(begun), pa.array(begun + text_start), pa.array(begun + text_end), pa.array(learned, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])

    return dealt.mapInArrow(run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces say: turns, text under the loss mask, and code points.

    Reads the output alone: roles and texts come from parsing ``formatted``, learned text from the masked span. The
    pieces of a conversation are walked in order, with one running digest for each of the two results.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    dealt = pieces.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        last, state, out = None, None, []
        close = lambda: out.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for conv, place, text, begun, lo, hi, learned in zip(*(columns[n] for n in ("conv_id", "place", "formatted", "start_chars", "text_start", "text_end", "learned"))):
                if place == 0:
                    if state:
                        close()
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = PIECE.fullmatch(text)
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state[4] += len(text)
                if learned:
                    under = unescape(text[lo - begun : hi - begun])
                    state[2] += len(under)
                    state[3].update(under.encode())
            if len(out) >= SLICE_ROWS:
                yield flush()
                out.clear()
        if state:
            close()
        yield flush()

    return dealt.mapInArrow(run, schema)


def formatted(conversations: DataFrame) -> DataFrame:
    """The digests of every conversation, and of one made of control strings under the id -7."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(rows))
