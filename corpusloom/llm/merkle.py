"""Merkle manifest of a table: leaf digests, one root, and each leaf's proof by pointer jumping.

Rows are numbered once by a range sort on (source, id, digest), so neither a
source nor a repeated id meets in one task.  A source's leaves, in that order,
are its level 0; each FAN consecutive nodes of a level become one node of the
next, until one is left, the subroot.  The subroots, in the order of their
sources, are level 0 of the upper tree (number TOP), which ends in the root.
Every level is one aggregation over narrow keys, a third as large as the last.

A node's link names its parent and holds one segment: the digests of its run to
its left and to its right.  A jump joins the links with themselves: a pointer to a
node is replaced by that node's pointer, and the two lists of segments are
concatenated, which doubles the distance.  After log2(depth) rounds every leaf
points at the root and holds its whole proof.  Only nodes that a later round may
still point at stay in the table: the leaves, every 2^k-th level of the sources'
trees, and the upper tree.

Digests are 32 bytes in the tables and hex text where they are hashed.  Tables
between rounds lie in the shared folder.

Defined results: a null field is `-`; null sources come first and form one group,
null ids come first in it; rows that are equal in every field are leaves of their
own, side by side, and rows of one id are ordered by their digests; a table of one
row has its leaf as root and an empty proof; an empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, materialize, release, sort_and_number, with_place

#: Consecutive nodes that make one of the next level.
FAN = 3
#: The upper tree's number; sources have 0 and up.
TOP = -1
#: Sources, or targets of a jump, up to which their table is broadcast.
BROADCAST_SOURCES, BROADCAST_TARGETS = 200_000, 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENTS = "array<struct<left:array<binary>,right:array<binary>>>"


def field(c) -> Column:
    """A field as it is hashed: `-` where null, else its UTF-8 bytes' number, a colon, and its text."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*inputs) -> Column:
    """SHA-256 of the inputs, concatenated, as bytes."""
    return F.unhex(F.sha2(F.concat(*inputs), 256))


def as_text(c) -> Column:
    return F.lower(F.hex(c))


def leaf_digest(text: Column | None = None, fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> Column:
    """The leaf of a row; text stands in for its text column."""
    return digest(*[field(text if text is not None and c == text_col else c) for c in fields])


def _levels(n: int) -> int:
    """Levels above a level of n nodes."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def _height(n: Column) -> Column:
    """_levels of a column."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(40)), F.lit(0)).cast("int")


def _build(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """Levels above nodes (tree, idx, digest, height: levels above level 0): one table of runs (tree, level, idx, height, digests) each, written.

    level and idx are those of the run's parent.
    """
    built = []
    for level in range(1, _levels(most) + 1):
        held = [F.max(F.when(F.col("idx") % FAN == i, F.col("digest"))).alias(f"d{i}") for i in range(FAN)]
        runs = nodes.where(F.col("height") >= level).groupBy("tree", F.expr(f"idx div {FAN}").alias("idx")).agg(F.first("height").alias("height"), *held)
        digests = F.filter(F.array(*[f"d{i}" for i in range(FAN)]), lambda d: d.isNotNull())
        runs = materialize(runs.select("tree", F.lit(level).alias("level"), "idx", "height", digests.alias("digests")), label)
        built.append(runs)
        nodes = runs.select("tree", "idx", "height", digest(F.array_join(F.transform("digests", as_text), "")).alias("digest"))
    return built


def _links(runs: list[DataFrame]) -> DataFrame:
    """(tree, level, idx) of each node below a run, (p_tree, p_level, p_idx) of its parent, and its one segment."""
    every = None
    for table in runs:
        n = F.size("digests")
        one = table.select("tree", (F.col("level") - 1).alias("level"), F.col("idx").alias("p_idx"), "height", "digests", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
        segment = F.struct(F.slice("digests", F.lit(1), F.col("i")).alias("left"), F.slice("digests", F.col("i") + 2, n).alias("right"))
        one = one.select("tree", "level", (F.col("p_idx") * FAN + F.col("i")).alias("idx"), F.col("tree").alias("p_tree"), (F.col("level") + 1).alias("p_level"), "p_idx", "height", F.array(segment).cast(_SEGMENTS).alias("segments"))
        every = one if every is None else every.unionByName(one)
    return every


_NODE, _POINTER = ["tree", "level", "idx"], ["p_tree", "p_level", "p_idx"]


def _jump(links: DataFrame, root: tuple[int, int, int], longest: int) -> DataFrame:
    """Leaves' (tree, idx, segments), segments leading from the leaf to the root; links are written tables' rows."""
    at_root = (F.col("p_tree") == root[0]) & (F.col("p_level") == root[1]) & (F.col("p_idx") == root[2])
    leaf = (F.col("tree") != TOP) & (F.col("level") == 0)
    held, done, distance = materialize(links, "merkle-links"), [], 1
    while distance < longest:
        # a target of this round is at a multiple of the distance above the leaves, or in the upper tree
        targets = held.where((F.col("tree") == TOP) | ((F.col("level") > 0) & (F.col("level") % distance == 0)))
        targets = targets.select(*[F.col(n).alias(p) for n, p in zip(_NODE, _POINTER)], *[F.col(p).alias(f"next_{p}") for p in _POINTER], F.col("segments").alias("further"))
        done.append(held.where(leaf & at_root).select("tree", "idx", "segments"))
        far = held.where(~at_root)
        near = held.where(~leaf & at_root)  # they stay as targets
        joined = bounded_join(far, targets, _POINTER, BROADCAST_TARGETS)
        moved = joined.select(*_NODE, *[F.col(f"next_{p}").alias(p) for p in _POINTER], F.concat("segments", "further").alias("segments"))
        distance *= 2
        keep = leaf | (F.col("tree") == TOP) | ((F.col("level") > 0) & (F.col("level") % distance == 0))
        held = materialize(moved.unionByName(near.select(*moved.columns)).where(keep), "merkle-jump")
    done.append(held.where(leaf & at_root).select("tree", "idx", "segments"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def fold(leaf, segments) -> Column:
    """The root that a leaf's digest and its segments lead to."""
    side = lambda s: F.array_join(F.transform(s, as_text), "")
    return F.aggregate(segments, leaf, lambda acc, s: digest(side(s["left"]), as_text(acc), side(s["right"])))


def proof_text(segments) -> Column:
    """The digests of a proof as hex text, level by level, left to right."""
    return F.array_join(F.transform(segments, lambda s: F.array_join(F.transform(F.concat(s["left"], s["right"]), as_text), "")), "")


def manifest(rows: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, id, leaf, subroot, root, segments of each row and the columns named in keep; digests are bytes.

    rows hold the leaf's digest in the column leaf, and are read once.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), "leaf", *keep)
    # written first: the sort samples its input, and texts are hashed once.  _row parts rows that are equal in all else
    named = materialize(named.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    sorted_rows, offsets = sort_and_number(named, "merkle-sorted", "source", "id", "leaf", "_row")
    release(named)
    held = sorted_rows.drop("_row")
    counted = with_place(held.select("source", "part", "local"), offsets).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    source_rows, source_offsets = sort_and_number(counted, "merkle-sorted", "source")
    sources = with_place(source_rows, source_offsets).select("source", "n", "first", F.col("place").alias("tree"), _height(F.col("n")).alias("height"))
    sources = materialize(sources, "merkle-sources")
    n_sources, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    named_sources = sources.withColumnRenamed("source", "_source")
    placed = with_place(held, offsets)
    few = n_sources <= BROADCAST_SOURCES
    placed = placed.join(F.broadcast(named_sources) if few else named_sources, F.col("source").eqNullSafe(F.col("_source")))
    leaves = materialize(placed.select("tree", (F.col("place") - F.col("first")).alias("idx"), "source", "id", "leaf", "height", *keep), "merkle-leaves")
    release(sorted_rows, source_rows)

    lower = _build(leaves.select("tree", "idx", "height", F.col("leaf").alias("digest")), most, "merkle-runs")
    # the subroot of a source: its last run's digest, or its only leaf
    last = [t.where("level = height").select("tree", digest(F.array_join(F.transform("digests", as_text), "")).alias("subroot")) for t in lower]
    subroots = leaves.where("height = 0").select("tree", F.col("leaf").alias("subroot"))
    for more in last:
        subroots = subroots.unionByName(more)
    subroots = materialize(subroots, "merkle-subroots")
    high = _levels(n_sources)
    upper = _build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(high).alias("height")), n_sources, "merkle-upper")
    top = upper[-1].select(digest(F.array_join(F.transform("digests", as_text), "")).alias("d")) if upper else subroots.select(F.col("subroot").alias("d"))
    found = top.first()
    root = found["d"] if found else b""  # 32 bytes

    # subroots are the upper tree's leaves: a pointer at one is a pointer at that leaf
    link = None
    if lower:
        link = _links(lower)
        to_top = F.col("p_level") == F.col("height")
        link = link.select(*_NODE, F.when(to_top, F.lit(TOP)).otherwise(F.col("p_tree")).cast("long").alias("p_tree"), F.when(to_top, 0).otherwise(F.col("p_level")).alias("p_level"), F.when(to_top, F.col("tree")).otherwise(F.col("p_idx")).alias("p_idx"), "segments")
    if upper:
        above = _links(upper).select(*_NODE, *_POINTER, "segments")
        link = above if link is None else link.unionByName(above)
        # a source of one leaf is that leaf: it starts where the upper tree's leaf starts
        single = leaves.where("height = 0").select("tree", "idx")
        starts = above.where("level = 0").select(F.col("idx").alias("tree"), *_POINTER, "segments")
        single = bounded_join(starts, single, "tree", BROADCAST_SOURCES).select("tree", F.lit(0).alias("level"), "idx", *_POINTER, "segments")
        link = link.unionByName(single)
    with_subroot = bounded_join(leaves, subroots, "tree", BROADCAST_SOURCES)
    if link is None:
        done = with_subroot.withColumn("segments", F.array().cast(_SEGMENTS))
    else:
        proofs = _jump(link, (TOP, high, 0), _levels(most) + high)
        # both sides hold every leaf once
        done = with_subroot.join(proofs, ["tree", "idx"])
    return done.select("source", "id", "leaf", "subroot", F.lit(root).alias("root"), "segments", *keep)


def tampered_text() -> Column:
    """The text without line feeds in rows whose id has an even CRC-32."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; the last two hold the tampered text against the proof.

    A null id is not tampered with.
    """
    rows = docs.select("source", "doc_id", leaf_digest().alias("leaf"), leaf_digest(tampered_text()).alias("tampered"))
    done = manifest(rows, keep=("tampered",))
    done = done.select(F.col("id").alias("doc_id"), *[as_text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof_text(F.col("segments")), 256).alias("proof_sha256"), as_text(fold(F.col("tampered"), F.col("segments"))).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The low bit of a CRC-32 by its definition; levels, runs and proofs by recursion.
ORACLE = r"""
WITH RECURSIVE
w AS (
  SELECT *, text IS NOT NULL AND doc_id IS NOT NULL AND list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), CAST(4294967295 AS BIGINT)) & 1 = 1 AS odd FROM documents),
h AS (SELECT doc_id, source, text, odd, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head FROM w),
d AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256(head || CASE WHEN text IS NULL THEN '-' WHEN odd THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END) AS forged FROM h),
l AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
t AS (
  SELECT tree, 0 AS level, idx, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM t) WHERE c > 1 GROUP BY tree, level, idx // 3),
s AS MATERIALIZED (SELECT tree, arg_max(digest, level) AS subroot, max(level) AS height FROM t GROUP BY tree),
u AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY level, idx // 3),
r AS (SELECT tree, level + 1 AS level, idx // 3 AS run, list(digest ORDER BY idx) AS ds FROM t JOIN s USING (tree) WHERE level < height GROUP BY tree, level, idx // 3),
top AS (SELECT level + 1 AS level, idx // 3 AS run, list(digest ORDER BY idx) AS ds FROM u WHERE level < (SELECT max(level) FROM u) GROUP BY level, idx // 3),
p AS (
  SELECT rid, level AS ord, ds, CAST(idx // CAST(pow(3, level - 1) AS BIGINT) % 3 AS INTEGER) AS own FROM l JOIN r ON r.tree = l.tree AND r.run = l.idx // CAST(pow(3, level) AS BIGINT)
  UNION ALL
  SELECT rid, 100 + level, ds, CAST(tree // CAST(pow(3, level - 1) AS BIGINT) % 3 AS INTEGER) FROM l JOIN top ON top.run = tree // CAST(pow(3, level) AS BIGINT)),
k AS (SELECT rid, list(array_to_string(ds[1:own], '') || '|' || array_to_string(ds[own + 2:], '') ORDER BY ord) AS steps FROM p GROUP BY rid),
f AS (SELECT l.*, subroot, (SELECT arg_max(digest, level) FROM u) AS root, coalesce(steps, []) AS steps FROM l JOIN s USING (tree) LEFT JOIN k USING (rid)),
g AS (SELECT *, list_reduce(steps, lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2)), forged) AS folded FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, coalesce(folded, forged) AS folded_root, coalesce(folded, forged) = root AS verified FROM g"""
