"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text's units are its words (lower case, cut at white space), with ``K - 1`` border marks before and behind them, so
texts of any length have the same kind of anchors. Every run of ``S`` units has a hash. A run of ``K`` units is a closed
syncmer if, of the ``S``-runs inside it, the smallest hash is the first or the last one: whether it is chosen depends on
it alone and not on what stands around it, so equal passages keep equal anchors wherever they are. At least one of
``K - S`` neighbouring runs is chosen.

The fingerprint has all anchors in order: for each one hex digit, the distance from the anchor before (from the border
for the first), and eight, the 32-bit hash of its run; so places can be read back from it. Likeness matches anchors by
place: a step is an anchor, the one before it and the distance between them, wherever it stands; likeness is the share
of common steps among the distinct steps of both fingerprints.

``neighbours`` pairs each row with the next one by descending id without a global sort in one task: ids are cut at
quantiles into buckets, and the highest row of each bucket is also dealt, as a guest, to the bucket above, whose last
row is followed by it. The highest row of all follows the last. Only texts are moved; anchors are made after it.

Defined results: a null text is the empty text, whose fingerprint is empty and like only to itself; so is that of a text
of white space; ties of ids are ordered by text, null ids come last; repeated rows have equal fingerprints; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2
#: Rows of a bucket, about, and the most buckets for each shuffle partition.
BUCKET_ROWS, BUCKETS_EACH = 1000, 4
#: An anchor's hash is in the low bits of its item, the distance above them.
HASH_BITS = 32


def with_hashes(df: DataFrame, text: str, h: str, s: str) -> DataFrame:
    """``df`` with the hashes ``h`` of the units of column ``text``, borders included, and ``s`` of its runs of ``S`` units.

    Both are empty for a text without words.
    """
    u, borders = f"_{h}_u", ", ".join(["0L"] * (K - 1))
    df = df.withColumn(u, F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")))
    df = df.withColumn(h, F.expr(f"if({u} = '', cast(array() as array<bigint>), concat(array({borders}), transform(split({u}, ' '), x -> xxhash64(x)), array({borders})))")).drop(u)
    return df.withColumn(s, F.expr(f"transform({h}, (x, i) -> xxhash64(x, {', '.join(f'get({h}, i + {d})' for d in range(1, S))}))"))


def run_hash(h: str, s: str) -> str:
    """The hash of the ``K`` units at place i, whose first run is x."""
    parts = [f"get({s}, i + {d})" for d in range(S, K - S + 1, S)] + [f"get({h}, i + {K - 1})"]
    return f"xxhash64(x, {', '.join(parts)}) & {(1 << HASH_BITS) - 1}L"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with array ``out`` of struct(pos, hash): the closed syncmers of column ``text`` (not null) in order."""
    h, s = f"_{out}_h", f"_{out}_s"
    inner = ", ".join(f"get({s}, i + {d})" for d in range(1, K - S))
    chosen = f"transform({s}, (x, i) -> if(i <= size({h}) - {K} and least(x, get({s}, i + {K - S})) <= least({inner}), struct(i as pos, {run_hash(h, s)} as hash), null))"
    return with_hashes(df, text, h, s).withColumn(out, F.expr(f"array_compact({chosen})")).drop(h, s)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, an item (distance and hash in one number) for each anchor, and ``out``_steps, the distinct steps."""
    a, mask = f"_{out}_a", f"{(1 << HASH_BITS) - 1}L"
    df = with_anchors(df, text, a)
    df = df.withColumn(out, F.expr(f"transform({a}, (x, i) -> shiftleft(bigint(x.pos - if(i = 0, -1, get({a}, i - 1).pos)), {HASH_BITS}) | x.hash)")).drop(a)
    return df.withColumn(f"{out}_steps", F.expr(f"array_distinct(transform({out}, (x, i) -> xxhash64(x, if(i = 0, -1L, get({out}, i - 1) & {mask}))))"))


def told(fingerprint: str) -> Column:
    return F.expr(f"lower(array_join(transform({fingerprint}, x -> hex(x)), ''))")


def likeness(a: str, b: str) -> Column:
    """Share of common steps among those of both; 1 for two empty texts."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D else {both} / cast(size({a}) + size({b}) - {both} as double) end")


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``bucket`` and ``guest``: ascending runs of ``key``, and guests as told above."""
    spark = rows.sparkSession
    n, top = rows.agg(F.count(F.lit(1)), F.max(key)).first()
    if not n:
        return rows.withColumns({"bucket": F.lit(0), "guest": F.lit(False)})
    most = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, min(most, -(-n // BUCKET_ROWS)))
    shares = [(i + 1) / count for i in range(count)]
    bounds = sorted({*rows.agg(F.percentile_approx(key, shares, 20 * count)).first()[0], top})
    array = f"array({', '.join(f'{b}L' if b > -(2**63) else '-9223372036854775807L - 1L' for b in bounds)})"
    steps = ", ".join(str(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1))
    bucket = f"aggregate(array({steps}), 0, (at, d) -> if(at + d < {len(bounds)} and {array}[at + d - 1] < {key}, at + d, at))"
    placed = rows.withColumn("_bucket", F.expr(bucket))
    own, guest = "struct(_bucket as bucket, false as guest)", f"struct((_bucket + 1) % {len(bounds)} as bucket, true as guest)"
    return placed.withColumn("_place", F.explode(F.expr(f"if({key} = {array}[_bucket], array({own}, {guest}), array({own}))"))).select(*rows.columns, "_place.bucket", "_place.guest")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text, n_chars, its fingerprint (items and steps), the edited text and the next row's steps."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key")
    rows = docs.select(F.col(id_col).alias("id"), key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_fingerprint(bucketed(rows, "key").repartition("bucket"), "text", "own")
    order = Window.partitionBy("bucket").orderBy(F.asc("guest"), F.desc("key"), F.asc("text"))
    rows = rows.withColumn("next", F.lead(F.struct("text", "own_steps")).over(order)).where(~F.col("guest"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = "cast(floor(n_chars / 3) as int)"
    edited = F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {cut}), substring(next.text, 1, {cut}))")
    return rows.select("id", "n_chars", "own", "own_steps", edited.alias("edited"), F.col("next.own_steps").alias("next_steps"))


def report(docs: DataFrame) -> DataFrame:
    rows = with_fingerprint(neighbours(docs), "edited", "changed")
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        told("own").alias("fingerprint"),
        told("changed").alias("edited_fingerprint"),
        likeness("own_steps", "changed_steps").alias("near_edited"),
        likeness("own_steps", "next_steps").alias("near_next"),
    )
