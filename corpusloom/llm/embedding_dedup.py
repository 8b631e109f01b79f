"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Equal vectors form a class; one vector stands for it and the class counts with
its number of rows.  A table's hash rotates the vector (three rounds of random
signs and a fast Hadamard transform, one rotation per hash) and takes the
nearest vertices of the cross-polytope; ``hashes`` vertices make a bucket.
Every class goes into its ``probes`` best buckets of each table (multiprobe on
both sides).  Buckets take ids and a sketch of SKETCH bits (signs of random
projections), not vectors; large ones are cut into blocks, and each pair of blocks
is one tile.  A tile names those members whose sketch is near another's: at cosine
0.9 two sketches differ in 37 bits, give or take 6, of unrelated vectors in half of
them, and APART lies ten deviations beyond the former.  Only for these vectors are
fetched, to be compared by exact cosine in double precision.  A pair that meets in
several buckets counts in the first one only, so tiles emit counts and a spanning
forest, never pairs.

One set of parameters holds at every size.  MISSES has the measured share of pairs
of cosine exactly 0.9 that share no bucket, by dimension; closer pairs are missed
less, and all vectors are indexed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null id, link with nothing.  Vectors of different
lengths never link.  Rows that repeat an id are vectors of their own.  Ids must be
whole numbers (another type raises TypeError).  An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_join, materialize, release, whole_numbers
from .components import Forest, connected_components

COSINE = 0.9
SEED = 20240501
#: Classes of one block of a bucket.
BLOCK = 2048
#: Large buckets, and classes, up to which their table is broadcast.
BROADCAST_BUCKETS = 500_000
#: hashes, tables, probes
PLAN = (3, 9, 8)
#: Pairs of cosine 0.9 that share no bucket, of so many random pairs, by dimension.
MISSES = {64: (0, 20_000), 384: (9, 4_000), 768: (21, 4_000)}
#: Bits of a sketch, and how many may differ in a pair that is compared.
SKETCH, APART = 256, 96
#: Members up to which tiles are compared together.
LAGS = 24
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns, orthonormal; their length is a power of 2.  Overwrites x."""
    width, n = x.shape
    out, h = np.empty_like(x), 1
    while h < width:
        pairs, into = x.reshape(width // (2 * h), 2, h, n), out.reshape(width // (2 * h), 2, h, n)
        np.add(pairs[:, 0], pairs[:, 1], out=into[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=into[:, 1])
        x, out, h = out, x, h * 2
    x /= np.sqrt(width)
    return x


def rotate(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """The rows rotated; x holds them as columns, which keeps the butterflies of many vectors contiguous."""
    for r in range(ROUNDS):
        signs = np.random.default_rng([SEED, table, which, r, x.shape[0]]).choice(np.array([-1.0, 1.0]), x.shape[0])
        x = hadamard(x * signs[:, None])
    return np.ascontiguousarray(x.T)


def bucket_codes(unit: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """Bucket ids (rows, tables, probes) of unit vectors of one length; no two of a row and table are equal."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((width, n))
    padded[:dim] = unit.T
    near = min(width, max(2, probes))
    out = np.zeros((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        codes, loss = np.full((n, 1), dim * 1000 + t, dtype=np.uint64), np.zeros((n, 1))
        for h in range(hashes):
            y = rotate(padded, t, h)
            size = np.abs(y)
            at = np.argpartition(-size, near - 1, axis=1)[:, :near]
            at = np.take_along_axis(at, np.lexsort((at, -np.take_along_axis(size, at, 1)), axis=1), 1)
            top = np.take_along_axis(size, at, 1)
            vertex = (at * 2 + (np.take_along_axis(y, at, 1) < 0)).astype(np.uint64)
            codes = (codes[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + vertex[:, None, :] + np.uint64(1)).reshape(n, -1)
            loss = (loss[:, :, None] + (top[:, :1] - top)[:, None, :]).reshape(n, -1)
            if loss.shape[1] > probes:
                best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                codes, loss = np.take_along_axis(codes, best, 1), np.take_along_axis(loss, best, 1)
        codes ^= codes >> np.uint64(32)
        codes = (codes * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        if codes.shape[1] < probes:  # few dimensions: fewer buckets than probes; the rest repeat the first
            codes = np.concatenate((codes, np.repeat(codes[:, :1], probes - codes.shape[1], axis=1)), axis=1)
        out[:, t] = codes
    return out


def _describe(kind):
    """(id, embedding) to (id, digest, vector as bytes of numpy type kind); digest is null where the vector is not usable."""

    def run(batches):
        for batch in arrow_batches(batches):
            digests, vectors = [], []
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                digest, raw = None, None
                values = value.values if value.is_valid else None
                if id_ is not None and values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                        digest = hashlib.blake2b(raw, digest_size=16).digest()
                digests.append(digest)
                vectors.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "digest", "vector"])

    return run


def _unit(raw: list[bytes], kind) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(unit: np.ndarray) -> np.ndarray:
    """SKETCH bits of each row, as 64-bit words: the sides of random planes that it lies on."""
    planes = np.random.default_rng([SEED, unit.shape[1]]).normal(size=(unit.shape[1], SKETCH))
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint64)


def _coded(hashes: int, tables: int, probes: int, kind):
    """(cid, weight, vector) to these, their buckets and their sketch."""

    def run(batches):
        for batch in arrow_batches(batches, 2 << 20):
            raw = batch.column(2).to_pylist()
            codes, drawn = [None] * len(raw), [None] * len(raw)
            lengths = defaultdict(list)
            for i, r in enumerate(raw):
                lengths[len(r)].append(i)
            for at in lengths.values():
                unit = _unit([raw[i] for i in at], kind)
                for i, c, bits in zip(at, bucket_codes(unit, hashes, tables, probes), sketches(unit)):
                    codes[i], drawn[i] = c.ravel(), bits.tobytes()
            offsets = np.arange(len(raw) + 1, dtype=np.int32) * (tables * probes)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(drawn, pa.binary())], names=["cid", "weight", "vector", "codes", "sketch"])

    return run


def _runs(keys: np.ndarray):
    """Where each tile starts, its size, and the number of each row's tile; keys (rows, 3) are together by tile."""
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    sizes = np.diff(np.append(starts, len(keys)))
    return starts, sizes, np.repeat(np.arange(len(starts)), sizes)


def _small_pairs(keys: np.ndarray, sides: np.ndarray, sizes: np.ndarray, tile: np.ndarray):
    """The pairs of all tiles of at most LAGS rows, as (rows, distance): rows with the next, then the next but one, ..."""
    small, two = sizes[tile] <= LAGS, keys[:, 1] != keys[:, 2]
    for lag in range(1, min(LAGS, int(sizes.max()))):
        i = np.flatnonzero(small[:-lag] & (tile[lag:] == tile[:-lag]))
        i = i[~two[i] | (sides[i] != sides[i + lag])]
        if len(i):
            yield i, lag


def _near_members(keys: np.ndarray, sides: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which rows have a sketch near that of another row of their tile; keys (rows, 3) are together by tile, low < high pairs two sides."""
    starts, sizes, tile = _runs(keys)
    two, hit = keys[:, 1] != keys[:, 2], np.zeros(len(keys), bool)
    for i, lag in _small_pairs(keys, sides, sizes, tile):
        close = i[np.bitwise_count(bits[i] ^ bits[i + lag]).sum(axis=1, dtype=np.int64) <= APART]
        hit[close] = hit[close + lag] = True
    for t in np.flatnonzero(sizes > LAGS):
        own = np.arange(starts[t], starts[t] + sizes[t])
        apart = two[own[0]]
        rows, cols = (own[sides[own] == keys[own[0], 1]], own[sides[own] == keys[own[0], 2]]) if apart else (own, own)
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            close = np.bitwise_count(bits[some][:, None, :] ^ bits[cols][None, :, :]).sum(axis=2, dtype=np.int64) <= APART
            if not apart:
                close[np.arange(len(some)), np.arange(at, at + len(some))] = False
            hit[some] |= close.any(axis=1)
            hit[cols] |= close.any(axis=0)
    return hit


def _last_tile(columns) -> int:
    """Where the last tile, which may go on in the next batch, begins; its keys are the first three columns."""
    same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
    return 0 if same.all() else len(same) - int(np.argmin(same[::-1]))


def _near(batches):
    """Rows (bucket, low, high, side, cid, sketch), together by tile, to those of members whose sketch is near another's."""

    def found(columns):
        hit = np.flatnonzero(_near_members(np.stack(columns[:3], axis=1), columns[3], columns[5]))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c[hit], k) for c, k in zip(columns, kinds)], names=["bucket", "low", "high", "side", "cid"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
        now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, SKETCH // 64))
        if held is not None:
            now = [np.concatenate((x, y)) for x, y in zip(held, now)]
        last = _last_tile(now)
        if last:
            yield found([x[:last] for x in now])
        held = [x[last:] for x in now]
    if held is not None:
        yield found(held)


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the least bucket that both have in the first table in which they have any; codes (rows, tables, probes)."""
    out, left = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    found = np.zeros(len(a), dtype=bool)
    far = np.iinfo(np.int64).max
    for t in range(a.shape[1]):
        x, y = a[left, t], b[left, t]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        hit = same.any(axis=1)
        out[left[hit]] = np.where(same, x, far).min(axis=1)[hit]
        found[left[hit]] = True
        left = left[~hit]
        if not len(left):
            break
    return np.where(found, out, far)


def compare_bucket(bucket: int, two: bool, cids, weights, sides, vectors, codes, threshold: float, degree, forest) -> None:
    """Adds what one tile finds: partners' weights to degree, spanning links to forest."""
    rows = np.flatnonzero(sides == sides.min()) if two else np.arange(len(cids))
    cols = np.flatnonzero(sides != sides.min()) if two else rows
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        close = vectors[some] @ vectors[cols].T >= threshold
        i, j = np.nonzero(close)
        i, j = some[i], cols[j]
        keep = (i != j) if two else (i < j)
        i, j = i[keep], j[keep]
        for part in range(0, len(i), 200_000):
            a, b = i[part : part + 200_000], j[part : part + 200_000]
            here = _first_common(codes[a], codes[b]) == bucket
            a, b = a[here], b[here]
            if len(a):
                _add(degree, cids, weights, a, b)
                label = np.arange(len(cids))
                while True:
                    least = np.minimum(label[a], label[b])
                    if (least == label[a]).all() and (least == label[b]).all():
                        break
                    np.minimum.at(label, a, least)
                    np.minimum.at(label, b, least)
                for x in np.flatnonzero(label != np.arange(len(cids))).tolist():
                    forest.join(int(cids[x]), int(cids[label[x]]))


def _add(degree, cids, weights, a, b) -> None:
    """Adds the weights of the partners of pairs (a, b) of rows to degree, by cid."""
    keys, inverse = np.unique(cids[np.concatenate((a, b))], return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, weights[np.concatenate((b, a))])
    for x, w in zip(keys.tolist(), sums.tolist()):
        degree[x] += w


def compare_tiles(keys, cids, weights, sides, vectors, codes, threshold: float, degree, forest) -> None:
    """Adds what tiles find; rows are together by tile.  Small tiles are compared together, large ones by themselves."""
    starts, sizes, tile = _runs(keys)
    for i, lag in _small_pairs(keys, sides, sizes, tile):
        i = i[np.einsum("ij,ij->i", vectors[i], vectors[i + lag]) >= threshold]
        i = i[_first_common(codes[i], codes[i + lag]) == keys[i, 0]]
        _add(degree, cids, weights, i, i + lag)
        for x, y in zip(cids[i].tolist(), cids[i + lag].tolist()):
            forest.join(x, y)
    for t in np.flatnonzero(sizes > LAGS):
        own = slice(starts[t], starts[t] + sizes[t])
        bucket, low, high = keys[starts[t]].tolist()
        compare_bucket(bucket, low != high, cids[own], weights[own], sides[own], vectors[own], codes[own], threshold, degree, forest)


def _tiles(threshold: float, tables: int, probes: int, kind):
    """Rows (bucket, low, high, side, cid, weight, vector, codes), together by tile, to degrees and spanning links."""

    def run(batches):
        degree, forest, held = defaultdict(int), Forest(), None

        def compare(columns):
            bytes_each = np.fromiter(map(len, columns[6]), np.int64, len(columns[6]))
            for size in np.unique(bytes_each):
                own = np.flatnonzero(bytes_each == size)
                keys = np.stack(columns[:3], axis=1)[own]
                compare_tiles(keys, columns[4][own], columns[5][own], columns[3][own], _unit(columns[6][own].tolist(), kind), columns[7][own], threshold, degree, forest)

        def out():
            a, b = forest.stars()
            kinds = [pa.array(list(degree) + a.tolist(), pa.int64()), pa.array([None] * len(degree) + b.tolist(), pa.int64()), pa.array(list(degree.values()) + [None] * len(a), pa.int64())]
            return pa.RecordBatch.from_arrays(kinds, names=["a", "b", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy().astype(np.int64) for i in range(6)]
            raw = np.empty(batch.num_rows, dtype=object)
            raw[:] = batch.column(6).to_pylist()
            now += [raw, batch.column(7).flatten().to_numpy().reshape(-1, tables, probes)]
            if held is not None:
                now = [np.concatenate((x, y)) for x, y in zip(held, now)]
            last = _last_tile(now)
            if last:
                compare([x[:last] for x in now])
            held = [x[last:] for x in now]
            if len(degree) > 500_000 or len(forest.parent) > 500_000:
                yield out()
                degree, forest = defaultdict(int), Forest()
        if held is not None:
            compare(held)
        yield out()

    return run


def near_duplicates(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, plan: tuple[int, int, int] = PLAN) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    whole_numbers(embeddings, id_col)
    kind = embeddings.schema[id_col].dataType
    # vectors of single precision travel as such; all is computed in double
    single = embeddings.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    number = np.float32 if single else np.float64
    rows = materialize(rows.mapInArrow(_describe(number), "id long, digest binary, vector binary"), "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    hashes, tables, probes = plan
    coded = classes.select("cid", "weight", "vector").mapInArrow(_coded(hashes, tables, probes, number), "cid long, weight long, vector binary, codes array<long>, sketch binary")
    coded = materialize(coded, "vector-codes")
    entries = coded.select("cid", "sketch", F.explode(F.array_distinct("codes")).alias("bucket"))
    hot = entries.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    hot = materialize(hot, "vector-hot")
    dealt = bounded_join(entries, hot, "bucket", BROADCAST_BUCKETS, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.hash("cid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "cid", "sketch")
    tile = ["bucket", "low", "high"]
    near = dealt.repartition(*tile).sortWithinPartitions(*tile, "cid").mapInArrow(_near, "bucket long, low int, high int, side int, cid long")
    near = materialize(near, "vector-near")
    # float noise of one dot product stays below 1e-15 in any order of summing
    placed = near.join(coded.select("cid", "weight", "vector", "codes"), "cid").select(*tile, "side", "cid", "weight", "vector", "codes")
    found = placed.repartition(*tile).sortWithinPartitions(*tile, "cid").mapInArrow(_tiles(cosine, tables, probes, number), "a long, b long, w long")
    found = materialize(found, "vector-links")
    release(coded, hot, near)
    degree = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("degree"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    rooted = classes.select("cid", "digest", "least", "weight").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(names, "root").join(degree, "cid", "left").select("digest", (F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).alias("links"), "component")
    done = rows.select("id", "digest").join(known, "digest", "left")
    return done.select(
        F.col("id").cast(kind).alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").cast("long").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS MATERIALIZED (
  SELECT vec_id, list_transform(e, lambda x: x / s) AS e FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v)
  WHERE s > 0 AND isfinite(s)),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, CAST(c.component_id AS BIGINT) AS component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
