"""Packing into optimal length buckets.

Texts longer than ``max_len`` words are cut into sequences of max_len words and
a rest.  A global histogram of sequence lengths (max_len rows at most) goes to
the driver, where dynamic programming chooses the bucket boundaries that
minimise padding exactly.  Inside a bucket, batches hold as many sequences as
the token budget allows at the bucket's padded length; every batch of a bucket
is full but its last.

Sequences are numbered inside a bucket without gathering a bucket in one task:
equal rows (same id, piece and length) are counted, a bucket is dealt into SHARDS
hash shards, shard counts (buckets x SHARDS rows) give offsets, a shard numbers its
distinct rows, and a row of many copies is dealt out again by RUN copies.

A token of pack() is a word; pack_tokens() packs the ids of a byte-level vocabulary
and gives them, and padded_batches() the batches as matrices.

Defined results: a null or wordless text gives one row with n_tokens 0 and null
bucket, batch and slot; rows that repeat an id are packed each; ties are broken
by row content (equal rows are interchangeable); an empty table gives no rows.
Words are runs of non-white-space ([^\\x20\\x09-\\x0D]).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16384
SHARDS = 1024
#: Copies of one row that one task numbers.
RUN = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def optimal_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Ascending padded lengths of at most ``buckets`` buckets with the least total padding."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    d, k = len(lengths), min(buckets, len(lengths))
    # cost of padding all up to length j, given that i lengths are in earlier buckets: lengths[j] * (rows[j+1] - rows[i]), less a constant
    best = lengths * rows[1:]
    back = np.zeros((k, d), dtype=np.int64)
    for b in range(1, k):
        new = np.empty(d, dtype=np.int64)
        for j in range(d):
            if j < b:
                new[j], back[b, j] = best[j], back[b - 1, j]
                continue
            tried = best[b - 1 : j] + lengths[j] * (rows[j + 1] - rows[b : j + 1])
            at = int(np.argmin(tried))
            new[j], back[b, j] = tried[at], at + b - 1
        best = new
    chosen, j = [], d - 1
    for b in range(k - 1, -1, -1):
        chosen.append(int(lengths[j]))
        if b == 0:
            break
        j = int(back[b, j])
    return sorted(set(chosen))


def sequences(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """One row per sequence: id, piece, first_token, n_tokens."""
    return _pieces(documents.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("words")), id_col, max_len)


def _pieces(counted: DataFrame, id_col: str, max_len: int) -> DataFrame:
    """(id, words) cut into pieces of max_len."""
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / max_len).cast("long"), F.lit(1)) - 1)
    return counted.select("id", "words", F.explode(pieces).alias("piece")).select(
        F.col("id").alias(id_col), "piece", (F.col("piece") * max_len).alias("first_token"), F.least(F.col("words") - F.col("piece") * max_len, F.lit(max_len)).alias("n_tokens")
    )


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shards: int = SHARDS) -> DataFrame:
    """One row per sequence: id, piece, first_token, n_tokens, bucket, bucket_len, batch_id, slot."""
    rows = materialize(sequences(documents, id_col=id_col, text_col=text_col, max_len=max_len), "pack-sequences")
    return _assign(rows, id_col, buckets, token_budget, shards)


def _assign(rows: DataFrame, id_col: str, buckets: int, token_budget: int, shards: int) -> DataFrame:
    """Written sequences (id, piece, first_token, n_tokens) with their bucket, bucket_len, batch_id and slot."""
    histogram = {r[0]: r[1] for r in rows.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = optimal_boundaries(histogram, buckets)
    bucket, length = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(i)).otherwise(bucket)
        length = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(length)
    rows = rows.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket)).withColumn("bucket_len", F.when(F.col("n_tokens") > 0, length))
    shard = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("piece").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % shards
    rows = rows.withColumn("shard", shard)
    full = rows.where("bucket is not null")
    same = ["bucket", "bucket_len", "shard", id_col, "piece", "first_token", "n_tokens"]
    distinct = full.groupBy(*same).agg(F.count("*").alias("copies"))
    sizes = full.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket", "shard").orderBy(F.col(id_col).asc_nulls_first(), "piece", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    numbered = distinct.withColumn("rank", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(F.broadcast(offsets), ["bucket", "shard"])
    numbered = numbered.withColumn("rank", F.col("offset") + F.col("rank"))
    once, often = numbered.where("copies = 1"), numbered.where("copies > 1")
    runs = often.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))).repartition("bucket", "rank", "run")
    runs = runs.withColumn("nth", F.explode(F.sequence("run", F.least(F.col("run") + RUN, "copies") - 1)))
    numbered = once.unionByName(runs.withColumn("rank", F.col("rank") + F.col("nth")).drop("run", "nth"))
    index, room = F.col("rank"), F.floor(F.lit(token_budget) / F.col("bucket_len"))
    room = F.greatest(room, F.lit(1))
    done = numbered.select(
        id_col, "piece", "first_token", "n_tokens", "bucket", "bucket_len", F.floor(index / room).cast("long").alias("batch_id"), (index % room).cast("long").alias("slot")
    )
    none = rows.where("bucket is null").select(id_col, "piece", "first_token", "n_tokens", "bucket", "bucket_len", F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("long").alias("slot"))
    return done.unionByName(none)


def pack_tokens(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shards: int = SHARDS) -> DataFrame:
    """pack() by the ids of a byte-level vocabulary: one row per sequence with its ids.

    Columns: id, piece, first_token, first_byte (where the sequence starts in its text), n_tokens, bucket, bucket_len,
    batch_id, slot, token_ids (little-endian unsigned 32-bit integers).  A row is told from others of its id by its place in
    the encoded table, so texts of a repeated id keep their own ids.
    """
    encoded = bpe.encode(documents, id_col=id_col, text_col=text_col, vocabulary=vocabulary).withColumn("_row", F.monotonically_increasing_id())
    encoded = materialize(encoded, "pack-tokens")
    rows = materialize(_pieces(encoded.select(F.col("_row").alias("id"), F.col("n_tokens").alias("words")), "_row", max_len), "pack-pieces")
    placed = _assign(rows, "_row", buckets, token_budget, shards)
    at, n = F.col("first_token") * 4 + 1, F.col("p.n_tokens") * 4
    first = bpe.unsigned_at("token_offsets", F.col("first_token"))
    both = placed.alias("p").join(encoded.select("_row", F.col(id_col).alias("_id"), "token_ids", "token_offsets"), "_row")
    return both.select(F.col("_id").alias(id_col), "piece", "first_token", F.coalesce(first, F.lit(0)).alias("first_byte"), "p.n_tokens", "bucket", "bucket_len", "batch_id", "slot", F.substring("token_ids", at, n).alias("token_ids"))


def padded_batches(packed: DataFrame, pad: int, *, id_col: str = "doc_id") -> DataFrame:
    """One row per batch of pack_tokens(): bucket, batch_id, bucket_len, its sequences (id, piece, n_tokens) by slot, and tokens, their ids padded to bucket_len.

    A batch holds no more ids than the token budget, or one sequence.
    """
    held = packed.where("bucket is not null").withColumn("row", F.expr(f"rpad(token_ids, CAST(bucket_len * 4 AS INT), X'{pad.to_bytes(4, 'little').hex()}')"))
    of = F.struct("slot", F.struct(F.col(id_col), "piece", "n_tokens").alias("sequence"), F.hex("row").alias("row"))
    batches = held.groupBy("bucket", "batch_id", "bucket_len").agg(F.sort_array(F.collect_list(of)).alias("b"))
    return batches.select("bucket", "batch_id", "bucket_len", F.col("b.sequence").alias("sequences"), F.unhex(F.array_join("b.row", "")).alias("tokens"))


def _oracle() -> str:
    """DuckDB SQL of pack() with its default parameters: one step of the dynamic programming for each further bucket."""
    steps = []
    for b in range(1, BUCKETS):
        steps.append(f"""
t{b} AS MATERIALIZED (
  SELECT j.i, coalesce(m.best, p.best) AS best, coalesce(m.back, p.back) AS back
  FROM l j JOIN t{b - 1} p ON p.i = j.i
  LEFT JOIN (SELECT j.i, min(q.best + j.len * (j.upto - a.upto)) AS best, arg_min(q.i, (q.best + j.len * (j.upto - a.upto)) * 100000 + q.i) AS back
             FROM l j JOIN t{b - 1} q ON q.i < j.i AND q.i >= {b - 1} JOIN l a ON a.i = q.i WHERE j.i >= {b} GROUP BY j.i) m ON m.i = j.i)""")
    chosen = [f"c{BUCKETS - 1} AS (SELECT max(i) AS i FROM l)"]
    chosen += [f"c{b - 1} AS (SELECT back AS i FROM t{b} JOIN c{b} USING (i))" for b in range(BUCKETS - 1, 0, -1)]
    ends = " UNION ".join(f"SELECT i FROM c{b}" for b in range(BUCKETS))
    return f"""
WITH w AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, piece, piece * {MAX_LEN} AS first_token, least(n - piece * {MAX_LEN}, {MAX_LEN}) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / {MAX_LEN}) AS BIGINT), 1))) AS piece FROM w)),
l AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n_tokens) - 1 AS i, n_tokens AS len, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS upto FROM s WHERE n_tokens > 0 GROUP BY n_tokens),
t0 AS MATERIALIZED (SELECT i, len * upto AS best, CAST(0 AS BIGINT) AS back FROM l),{",".join(steps)},
{", ".join(chosen)},
e AS (SELECT CAST(row_number() OVER (ORDER BY len) - 1 AS INTEGER) AS bucket, len AS bucket_len FROM l WHERE i IN ({ends})),
p AS (
  SELECT s.*, (SELECT min(bucket) FROM e WHERE bucket_len >= n_tokens) AS bucket,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || piece), 1, 8) AS BIGINT) % {SHARDS} AS shard FROM s),
q AS (
  SELECT p.*, bucket_len, greatest({TOKEN_BUDGET} // bucket_len, 1) AS room,
         row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id NULLS FIRST, piece, n_tokens) - 1 AS k FROM p JOIN e USING (bucket) WHERE n_tokens > 0)
SELECT doc_id, piece, first_token, n_tokens, bucket, bucket_len, CAST(k // room AS BIGINT) AS batch_id, CAST(k % room AS BIGINT) AS slot FROM q
UNION ALL SELECT doc_id, piece, first_token, n_tokens, NULL, NULL, NULL, NULL FROM s WHERE n_tokens = 0
"""


ORACLE = _oracle()
