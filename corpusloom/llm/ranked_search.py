"""Ranked lexical search of a set of items against all documents, by a dual tree.

Scores are sums over an item's terms of a weight (rarity) times an impact (how
often a term occurs in a document, against its length), in whole numbers.  Both
sides have hierarchies whose nodes hold coordinate maxima: a node of documents the
greatest impact of each term below it, a node of items the greatest weight.  The
sum of the products of two nodes' maxima bounds the score of every pair below
them, so a pair of nodes whose bound is below the weakest kth score of its items
is left out, exactly.

The upper levels are tables.  Documents are range-sorted by their rarest term and
their length and cut into chunks, items by their rarest term into blocks; a join
of the chunks' and blocks' maxima gives each pair's bound.  A first wave searches
each block's best chunks; the scores it finds set the items' floors, and a second
wave searches the pairs whose bound reaches the least floor of their block.  The
lower levels are arrays in a task, which holds one chunk and one block: groups of
leaves, leaves and documents on one side, nodes and items on the other.

Nothing is collected but totals and a bitmap of the items' terms of fixed size
(SLOTS), by which the tokenising pass leaves out most other terms; what passes by
chance goes in the join with the items' terms.  Every document and every item is
searched; no candidate is capped.

Defined results: null and empty texts have no terms, take no part in the totals
and are never found; documents without any of an item's terms are not ranked; a
repeated document row is a document of its own, and so is a repeated item row;
equal scores go by doc_id, null ids last; document ids must be whole numbers
(another type raises TypeError); without documents or items there are no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_join, materialize, release, small_batches, sort_and_number, table, whole_numbers, with_place

#: Results an item.
BEST = 10
#: Slots of the bitmap of terms: a byte each in a worker.
SLOTS = 1 << 22
#: Documents of a chunk, of a leaf, leaves of a group; items of a block and of a node.
CHUNK, LEAF, GROUP = 2048, 32, 8
BLOCK, NODE = 256, 16
#: Chunks of each block in the first wave.
FIRST_CHUNKS = 4
#: Cells of the table of weights in a task; a block with more is searched in halves.
MOST_CELLS = 1 << 23
#: Rows up to which a table of terms, of pairs or of items' floors is broadcast.
BROADCAST_TERMS, BROADCAST_PAIRS, BROADCAST_ITEMS = 500_000, 200_000, 200_000
#: Top-k rows of an item are merged in so many parts before they meet.
MERGE_PARTS = 64

# Fixed values of the score.
WEIGHT_SCALE, IMPACT_SCALE, LENGTH_PERCENT = 1000, 1_000_000_000, 90

_LOWER = bytes(range(97, 123))


def _byte_table() -> bytes:
    """Bytes to terms' bytes: A-Z lower-cased, digits, a-z and bytes from 0x80 kept, all others a blank."""
    kept = {**{b: b for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]}, **dict(zip(range(0x41, 0x5B), _LOWER))}
    return bytes(kept.get(b, 0x20) for b in range(256))


TERM_BYTES = _byte_table()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(TERM_BYTES).split()


def _lists(values: list[list], kind) -> pa.Array:
    flat = [v for one in values for v in one]
    held = pa.array(flat, pa.binary()).view(pa.string()) if kind is pa.string() else pa.array(flat, kind)
    return pa.ListArray.from_arrays(np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32), held)


def _tokenise(slots):
    """(row, id, text) to (row, id, n, terms, tfs): distinct terms, of which those whose slot is empty are left out; rows without a term go."""

    def run(batches):
        from zlib import crc32

        held = None if slots is None else slots.value
        for batch in arrow_batches(batches, 2 << 20):
            rows, ns, terms, tfs = [], [], [], []
            for at, text in enumerate(batch.column(2)):
                words = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                if not words:
                    continue
                counts = Counter(words)
                if held is not None:
                    counts = {t: n for t, n in counts.items() if held[crc32(t) % SLOTS]}
                rows.append(at)
                ns.append(len(words))
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            if rows:
                picked = pa.array(rows)
                arrays = [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(ns, pa.int64()), _lists(terms, pa.string()), _lists(tfs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n", "terms", "tfs"])

    return run


def _tokens(rows: DataFrame, id_col: str, text_col: str, slots, label: str) -> DataFrame:
    small_batches(rows.sparkSession)
    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return materialize(named.mapInArrow(_tokenise(slots), f"row long, id {kind}, n long, terms array<string>, tfs array<long>"), label)


def _slots(vocabulary: DataFrame):
    """A broadcast byte for each slot: whether a term of the vocabulary falls there."""
    slot = F.crc32(F.col("term").cast("binary")) % SLOTS + 1  # bitmap functions count from 1
    found = vocabulary.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("place"))
    flags = np.zeros(SLOTS, np.uint8)
    for bucket, bits in found.groupBy("bucket").agg(F.bitmap_construct_agg("place")).collect():  # SLOTS / 32768 rows of 4 KB at most
        bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        at = (bucket - 1) * len(bits)
        flags[at : at + len(bits)] = bits[: SLOTS - at]
    return vocabulary.sparkSession.sparkContext.broadcast(flags.tobytes())


def _postings(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """row, id, n, term, tf and the columns of known, by term."""
    each = tokens.select("row", "id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", "id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    return bounded_join(each, known, "term", BROADCAST_TERMS)


def _cut(rows: DataFrame, size: int, name: str, *order) -> DataFrame:
    """rows with the number of their run of size rows in the given order, and their place in the run."""
    numbered = with_place(*sort_and_number(rows, f"search-{name}", *order))
    return numbered.withColumn(name, F.floor(F.col("place") / size)).withColumn("place", (F.col("place") % size).cast("int"))


def _maxima(rows: DataFrame, name: str, values: str) -> DataFrame:
    """(name, term, most): a node's coordinate maxima."""
    each = rows.select(name, F.explode(F.arrays_zip("terms", values)).alias("t"))
    return each.groupBy(name, F.col("t.terms").alias("term")).agg(F.max(f"t.{values}").alias("most"))


class _Items:
    """The items of a block (or a half of it): a table of weights by the items' own terms, and the maxima of their nodes."""

    def __init__(self, table: pa.Table):
        terms = table.column("terms").combine_chunks()
        flat = terms.flatten()
        self.vocabulary = pc.unique(flat)
        self.table, n = table, table.num_rows
        columns = pc.index_in(flat, value_set=self.vocabulary).to_numpy()
        rows = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy())
        self.weights = np.zeros((n, len(self.vocabulary)), np.int64)
        self.weights[rows, columns] = table.column("weights").combine_chunks().flatten().to_numpy()
        self.nodes = np.maximum.reduceat(self.weights, np.arange(0, n, NODE), axis=0)
        self.floors = np.maximum(table.column("floor").to_numpy(), 1)  # a score must be above 0


class _Level:
    """Nodes of documents: entries (node, column, greatest impact), sorted by node."""

    def __init__(self, node: np.ndarray, column: np.ndarray, impact: np.ndarray, width: int):
        key = node.astype(np.int64) * width + column
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.node, self.column = key[first] // width, key[first] % width
        self.most = np.maximum.reduceat(impact[order], first) if len(key) else impact
        self.cuts = np.searchsorted(self.node, np.arange((int(node.max()) if len(node) else -1) + 2))

    def __len__(self):
        return len(self.cuts) - 1

    def of(self, i: int):
        part = slice(self.cuts[i], self.cuts[i + 1])
        return self.column[part], self.most[part]


def _search(documents: pa.Table, items: pa.Table, best: int) -> list[pa.RecordBatch]:
    """The best documents of a chunk for each item of a block that reach its floor: irow, item_id, doc_id, score."""
    cells = items.num_rows * sum(map(len, items.column("terms")), 0) if items.num_rows > NODE else 0
    if cells > MOST_CELLS * NODE:
        half = -(-items.num_rows // (2 * NODE)) * NODE
        return _search(documents, items.slice(0, half), best) + _search(documents, items.slice(half), best)
    known = _Items(items)
    width = len(known.vocabulary)
    documents = documents.sort_by("place")
    terms = documents.column("terms").combine_chunks()
    column = pc.fill_null(pc.index_in(terms.flatten(), value_set=known.vocabulary), -1).to_numpy()
    impact = documents.column("impacts").combine_chunks().flatten().to_numpy()
    document = np.repeat(np.arange(documents.num_rows), pc.list_value_length(terms).to_numpy())
    inside = column >= 0
    column, impact, document = column[inside], impact[inside], document[inside]
    if not len(column):
        return []
    # equal scores go by id: the rank of a document among the chunk's ids, null last
    ids = documents.column("id")
    rank = np.empty(documents.num_rows, np.int64)
    rank[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))] = np.arange(documents.num_rows)
    by_rank = np.argsort(rank)

    leaves = _Level(document // LEAF, column, impact, width)
    groups = _Level(leaves.node // GROUP, leaves.column, leaves.most, width)
    entry = np.searchsorted(document, np.arange(0, (len(leaves) + 1) * LEAF, LEAF))
    n = len(known.floors)
    scores, ranks = np.zeros((n, best), np.int64), np.full((n, best), documents.num_rows, np.int64)
    weakest = known.floors.copy()  # the least score that still counts
    bounds = np.array([known.nodes[:, c] @ m for c, m in (groups.of(g) for g in range(len(groups)))])
    for g in np.argsort(-bounds.max(axis=1), kind="stable"):
        least = np.minimum.reduceat(weakest, np.arange(0, n, NODE))
        nodes = np.flatnonzero(bounds[g] >= least)
        if not len(nodes):
            continue
        for leaf in range(g * GROUP, min((g + 1) * GROUP, len(leaves))):
            columns, most = leaves.of(leaf)
            if not len(columns):
                continue
            near = nodes[known.nodes[np.ix_(nodes, columns)] @ most >= np.minimum.reduceat(weakest, np.arange(0, n, NODE))[nodes]]
            wanted = (near[:, None] * NODE + np.arange(NODE)).ravel()
            wanted = wanted[wanted < n]
            if len(wanted):
                wanted = wanted[known.weights[np.ix_(wanted, columns)] @ most >= weakest[wanted]]
            if not len(wanted):
                continue
            part = slice(entry[leaf], entry[leaf + 1])
            starts = np.flatnonzero(np.append(True, np.diff(document[part]) > 0))
            found = np.add.reduceat(known.weights[np.ix_(wanted, column[part])] * impact[part], starts, axis=1)
            better = (found >= weakest[wanted, None]).any(axis=1)
            wanted, found = wanted[better], found[better]
            if not len(wanted):
                continue
            own = rank[document[part][starts]]
            both, with_ranks = np.hstack([scores[wanted], found]), np.hstack([ranks[wanted], np.broadcast_to(own, found.shape)])
            order = np.lexsort((with_ranks, -both), axis=-1)[:, :best]
            scores[wanted], ranks[wanted] = np.take_along_axis(both, order, 1), np.take_along_axis(with_ranks, order, 1)
            weakest[wanted] = np.maximum(weakest[wanted], scores[wanted, -1])
    item, place = np.nonzero(scores >= known.floors[:, None])
    if not len(item):
        return []
    at = pa.array(by_rank[ranks[item, place]])
    columns = [known.table.column("irow").take(pa.array(item)), known.table.column("item_id").take(pa.array(item)), ids.take(at), pa.chunked_array([pa.array(scores[item, place])])]
    return pa.table(columns, names=["irow", "item_id", "doc_id", "score"]).to_batches()


def _search_pairs(chunks: DataFrame, items: DataFrame, pairs: DataFrame, item_kind: str, best: int) -> DataFrame:
    """Searches the given pairs of chunk and block; pairs are a written table."""
    documents = bounded_join(chunks, pairs, "chunk", BROADCAST_PAIRS).select("chunk", "block", "place", "id", "terms", "impacts")
    sought = bounded_join(items, pairs, "block", BROADCAST_PAIRS).select("chunk", "block", "irow", "item_id", "terms", "weights", "floor")
    shape = f"irow long, item_id {item_kind}, doc_id long, score long"

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _search(left, right, best) if left.num_rows and right.num_rows else []
        if found:
            return pa.Table.from_batches(found)
        return pa.table({"irow": pa.array([], pa.int64()), "item_id": pa.array([], right.schema.field("item_id").type), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return documents.groupBy("chunk", "block").cogroup(sought.groupBy("chunk", "block")).applyInArrow(one, shape)


def _top(found: DataFrame, best: int, part=None) -> DataFrame:
    keys = ["irow"] if part is None else ["irow", part]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def rank_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    whole_numbers(docs, id_col)
    item_tokens = _tokens(items, item_col, item_text_col, None, "search-items")
    item_kind = item_tokens.schema["id"].dataType.simpleString()
    vocabulary = materialize(item_tokens.select(F.explode("terms").alias("term")).distinct(), "search-vocabulary")
    slots = _slots(vocabulary)
    tokens = _tokens(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, slots, "search-tokens")
    n_docs, length = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")
    if not n_docs:
        return empty

    df = _postings(tokens, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = materialize(df.select("term", weight.alias("w")), "search-weights")
    least = 100 - LENGTH_PERCENT
    m = f"({least}L + ({LENGTH_PERCENT}L * n * {n_docs}L) div {length}L)"
    impact = F.expr(f"({IMPACT_SCALE}L * tf) div (1000L * tf + 8L * {m})")

    hits = _postings(tokens, weights).withColumn("impact", impact)
    vectors = hits.groupBy("row").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.collect_list(F.struct("term", "impact")).alias("e"), F.max_by("term", F.struct("w", "term")).alias("rarest"))
    vectors = vectors.select("row", "id", "n", "rarest", F.col("e.term").alias("terms"), F.col("e.impact").alias("impacts"))
    vectors = materialize(vectors, "search-vectors")  # the sort samples its input
    release(tokens)
    chunks = _cut(vectors, CHUNK, "chunk", "rarest", "n", "row")
    release(vectors)

    of_item = bounded_join(item_tokens.select("row", "id", F.explode("terms").alias("term")), weights, "term", BROADCAST_TERMS)
    of_item = of_item.groupBy("row").agg(F.first("id").alias("item_id"), F.collect_list(F.struct("term", "w")).alias("e"), F.max_by("term", F.struct("w", "term")).alias("rarest"))
    of_item = materialize(of_item.select(F.col("row").alias("irow"), "item_id", "rarest", F.col("e.term").alias("terms"), F.col("e.w").alias("weights")), "search-weighed")
    if of_item.isEmpty():
        return empty
    blocks = _cut(of_item, BLOCK, "block", "rarest", "irow")

    of_chunk, of_block = materialize(_maxima(chunks, "chunk", "impacts"), "search-maxima"), materialize(_maxima(blocks, "block", "weights"), "search-heaviest")
    products = bounded_join(of_chunk, of_block.withColumnRenamed("most", "heaviest"), "term", BROADCAST_TERMS)
    bounds = materialize(products.groupBy("chunk", "block").agg(F.sum(F.col("most") * F.col("heaviest")).alias("bound")), "search-bounds")

    ahead = bounds
    for keys in (["block", F.col("chunk") % MERGE_PARTS], ["block"]):
        nearest = Window.partitionBy(*keys).orderBy(F.desc("bound"), "chunk")
        ahead = ahead.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= FIRST_CHUNKS).drop("_n")
    ahead = materialize(ahead.where("bound > 0"), "search-first")
    first = materialize(_search_pairs(chunks, blocks.withColumn("floor", F.lit(0).cast("long")), ahead, item_kind, best), "search-found")

    floors = _top(first, best).groupBy("irow").agg(F.when(F.count(F.lit(1)) == best, F.min("score")).otherwise(0).cast("long").alias("floor"))
    floors = materialize(floors, "search-floors")
    known = bounded_join(blocks, floors, "irow", BROADCAST_ITEMS, "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
    known = materialize(known, "search-known")
    lowest = materialize(known.groupBy("block").agg(F.min("floor").alias("floor")), "search-lowest")
    rest = bounds.join(ahead.select("chunk", "block"), ["chunk", "block"], "left_anti")
    rest = bounded_join(rest, lowest, "block", BROADCAST_ITEMS).where((F.col("bound") >= F.col("floor")) & (F.col("bound") > 0)).select("chunk", "block")
    rest = materialize(rest, "search-rest")
    found = first.unionByName(_search_pairs(chunks, known, rest, item_kind, best))
    merged = _top(found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))), best, "_part").drop("rank")
    return _top(merged, best).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_report(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, t GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), t GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
