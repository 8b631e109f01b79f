"""Positional postings laid out by term: phrases and block-max top-k search.

The index of a set of chunks is three tables in one folder.  Chunks that a task
reads one after the other form a block, and number in it from 0.  ``postings`` has
one row for each term and field of a block: the chunks that hold it, their lengths
and its positions there, and what bounds a score in the block, the greatest count
and the least length; ``chunks`` has one for each block: the paths, ids and lengths
of its chunks; ``stats`` has one row a field.  Postings are cut into folders by a hash
of the term and sorted by term, so a search lists only its terms' folders and skips
row groups by their statistics.

A search sums the bounds of its clauses over each block, scores the blocks of
greatest bound first, and then only those blocks whose bound reaches the kth best
score found.  That leaves out no chunk that belongs to the result.

A chunk's whole path is one exact term of the field ``path``.  A clause is a term
or a phrase.  A phrase's terms stand at the same distances as in the query; its
count in a field is the number of places where it starts there, and its rarity the
sum of its terms'.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..sources.tables import written
from .search import B, K1, TERM_BYTES, _strings, query_words, top

#: Folders of the index, chunks of a block, blocks of the first wave.
SHARDS, BLOCK_CHUNKS, FIRST_BLOCKS = 64, 256, 8
#: Characters of content after which a block ends before it is full.
BLOCK_CHARS = 8 << 20
#: Bytes of a row group: a search reads those that hold its terms.
ROW_GROUP = 1 << 20
#: Blocks up to which the list of a second wave is broadcast.
BROADCAST_BLOCKS = 200_000
FIELDS = ("title", "content")
_STATS = "field string, n long, mean_length double, shards int"
_HEADS = "term string, field string, block long, n long, most long, least long"
#: hits: the n chunks, their n lengths, the n ends of their positions, then all positions.
_POSTINGS = f"{_HEADS}, tf long, hits array<int>"
_CHUNKS = "block long, paths array<string>, ids array<string>, title_lengths array<int>, content_lengths array<int>"
_NO_TERM = -1
#: What a bound may fall short of by the order of additions.
SLACK = 1 + 1e-9


def placed_terms(c) -> Column:
    """(term, at) of each index term of a text; at counts all words, those too long to be indexed too."""
    words = F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at"))), lambda t: F.octet_length(t["term"]) <= TERM_BYTES)


def _word_ranges(spark: SparkSession) -> list[tuple[int, int]]:
    """The code points of words, as Spark's patterns know them: Python's tables are of another Unicode version."""
    if spark.version not in _RANGES:
        point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        letters = spark.range(0x110000).where("id not between 55296 and 57343").where(point.rlike(r"^[\p{IsAlphabetic}\p{N}]$"))
        runs = letters.select("id", (F.col("id") - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))).alias("run"))
        _RANGES[spark.version] = sorted(tuple(r) for r in runs.groupBy("run").agg(F.min("id"), F.max("id")).drop("run").collect())  # Unicode's, whatever the input
    return _RANGES[spark.version]


_RANGES: dict[str, list[tuple[int, int]]] = {}


def _cutter(ranges: list[tuple[int, int]]):
    """A function that gives the words of a lower-cased text; the narrowest of three patterns is the fastest."""
    every = lambda most: re.compile("[" + "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in ranges if a <= most) + "]+")
    plain, basic, whole, beyond = every(0x7F), every(0xFFFF), every(0x10FFFF), re.compile("[\U00010000-\U0010ffff]")
    return lambda text: (plain if text.isascii() else whole if beyond.search(text) else basic).findall(text)


def _inverted(texts: list[str], cut):
    """Terms of a field of a block's chunks, the chunks' lengths, and postings by term and chunk.

    Returns terms, lengths, first (of each term's postings, and their number last), chunks, ends (of each posting's
    positions in all) and positions.  A position counts all words, those too long to be indexed too.
    """
    words, counts = [], []
    for text in texts:
        found = cut(text)
        counts.append(len(found))
        words += found
    counts = np.array(counts, dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    short = pc.less_equal(pc.binary_length(terms), TERM_BYTES).to_numpy(zero_copy_only=False)
    if not short.all():
        kept = short[codes]
        codes, of, at = (np.cumsum(short) - 1)[codes[kept]], of[kept], at[kept]
        terms = terms.filter(pa.array(short))
    lengths = np.bincount(of, minlength=len(texts))
    order = np.argsort(codes, kind="stable")  # chunks and places ascend already
    codes, of, at = codes[order], of[order], at[order]
    starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])))) if len(codes) else np.zeros(0, np.int64)
    first = np.searchsorted(codes[starts], np.arange(len(terms) + 1))
    return terms, lengths, first, of[starts], np.append(starts[1:], len(codes))[: len(starts)], at


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


_LIST_NAMES = [c.split()[0] for c in _POSTINGS.split(", ")]
_SCHEMA = pa.schema(
    [*[(c, pa.string() if c in ("term", "field") else pa.list_(pa.int32()) if c == "hits" else pa.int64()) for c in _LIST_NAMES]]
    + [("paths", pa.list_(pa.string())), ("ids", pa.list_(pa.string())), ("title_lengths", pa.list_(pa.int32())), ("content_lengths", pa.list_(pa.int32()))]
)


def _block_postings(field: str, block: int, terms, lengths, first, chunks, ends, at) -> pa.RecordBatch:
    """Rows of postings: one for each term of a block's field."""
    n, own, heads = np.diff(first), lengths[chunks], first[:-1]
    begins = np.append(0, ends)[first]  # of each term's positions
    tf, total = np.diff(ends, prepend=0), np.diff(begins)
    offsets = 3 * first + begins
    hits, behind = np.empty(offsets[-1], np.int64), np.repeat(offsets[:-1], n) + np.arange(len(chunks)) - np.repeat(heads, n)
    wide = np.repeat(n, n)
    hits[behind], hits[behind + wide], hits[behind + 2 * wide] = chunks, own, ends - np.repeat(begins[:-1], n)
    hits[np.repeat(offsets[:-1] + 3 * n, total) + np.arange(len(at)) - np.repeat(begins[:-1], total)] = at
    numbers = (np.full(len(terms), block), n, np.maximum.reduceat(tf, heads), np.minimum.reduceat(own, heads), total)
    columns = [terms.cast(pa.string()), pa.array([field] * len(terms), pa.string()), *(pa.array(x, pa.int64()) for x in numbers), _lists(offsets, hits)]
    columns += [pa.nulls(len(terms), f.type) for f in list(_SCHEMA)[len(columns) :]]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _blocks_of(batches, most: int):
    """The rows of Arrow batches in groups of at most most rows and about BLOCK_CHARS characters: lists of columns."""
    held, chars = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            chars += len(row[-1] or "")
            if len(held) >= most or chars >= BLOCK_CHARS:
                yield [list(c) for c in zip(*held)]
                held, chars = [], 0
    if held:
        yield [list(c) for c in zip(*held)]


def _listed(chunks: DataFrame) -> DataFrame:
    """Posting lists of blocks, and a row without a term for each block: its chunks' paths, ids and lengths."""
    ranges, most = _word_ranges(chunks.sparkSession), BLOCK_CHUNKS

    def run(batches):
        cut, part = _cutter(ranges), TaskContext.get().partitionId() << 32
        for i, (paths, ids, titles, contents) in enumerate(_blocks_of(batches, most)):
            block, sizes = part + i, []
            for field, texts in zip(FIELDS, (titles, contents)):
                found = _inverted([t or "" for t in texts], cut)
                sizes.append(found[1].tolist())
                if len(found[0]):
                    yield _block_postings(field, block, *found)
            whole = pa.array(paths, pa.string()).dictionary_encode()
            codes = whole.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            of = np.argsort(codes, kind="stable")[int((codes < 0).sum()) :]
            if len(of):
                first = np.searchsorted(codes[of], np.arange(len(whole.dictionary) + 1))
                yield _block_postings("path", block, whole.dictionary, np.ones(len(paths), np.int64), first, of, np.arange(len(of)) + 1, np.zeros(len(of), np.int64))
            rest = {"block": block, "paths": paths, "ids": ids, "title_lengths": sizes[0], "content_lengths": sizes[1]}
            yield pa.RecordBatch.from_arrays([pa.array([rest.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)

    own = chunks.select("path", "chunk_id", *[F.lower(f).alias(f) for f in FIELDS])
    return own.mapInArrow(run, f"{_POSTINGS}, {_CHUNKS.split(', ', 1)[1]}")


_ROWS = "term string, field string, path string, chunk_id string, length long, tf long, positions array<int>"


def positional_postings(chunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """term, field, path, chunk_id, length, tf, positions: counted and placed within each chunk."""
    ranges, most = _word_ranges(chunks.sparkSession), BLOCK_CHUNKS

    def run(batches):
        cut = _cutter(ranges)
        names = [c.split()[0] for c in _ROWS.split(", ")]
        for paths, ids, *texts in _blocks_of(batches, most):
            for field, own in zip(fields, texts):
                terms, lengths, first, of, ends, at = _inverted([t or "" for t in own], cut)
                take = lambda values: pa.array(values, pa.string()).take(pa.array(of))
                term = terms.cast(pa.string()).take(pa.array(np.repeat(np.arange(len(terms)), np.diff(first))))
                numbers = [pa.array(x, pa.int64()) for x in (lengths[of], np.diff(ends, prepend=0))]
                yield pa.RecordBatch.from_arrays([term, pa.array([field] * len(of), pa.string()), take(paths), take(ids), *numbers, _lists(np.append(0, ends), at)], names=names)

    return chunks.select("path", "chunk_id", *[F.lower(f).alias(f) for f in fields]).mapInArrow(run, _ROWS)


def _by_chunk(lists: DataFrame) -> DataFrame:
    """term, field, block, chunk, length, positions: a row for each chunk of a posting list."""
    n = F.col("n").cast("int")
    end = lambda i: F.get("hits", 2 * n + i)
    begin = lambda i: F.when(i > 0, end(i - 1)).otherwise(0)
    own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("hits", i).alias("chunk"), F.get("hits", n + i).cast("long").alias("length"), F.slice("hits", 3 * n + begin(i) + 1, end(i) - begin(i)).alias("positions")))
    return lists.select("term", "field", "block", F.inline(own))


def shard_of(term, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def write_index(chunks: DataFrame, path: str, *, shards: int = SHARDS) -> None:
    """Writes the index of chunks (path, chunk_id, title, content) below path; each chunk is read and cut into terms once."""
    spark = chunks.sparkSession
    rows = _listed(chunks).withColumn("shard", F.when(F.col("term").isNull(), _NO_TERM).otherwise(shard_of("term", shards)))
    # a shard, and so a frequent term, is dealt to as many tasks as the shuffle's width has room for
    cuts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    done = rows.repartition("shard", F.pmod(F.xxhash64("block"), F.lit(cuts))).sortWithinPartitions("shard", "term")
    done.write.partitionBy("shard").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    # blocks' rows came along, so that chunks are cut once; they move to a table of their own
    apart = f"{path}/postings/shard={_NO_TERM}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(apart)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = spark.read.schema(_CHUNKS).parquet(apart) if files.exists(folder) else spark.createDataFrame([], _CHUNKS)
    found.write.parquet(f"{path}/chunks")
    files.delete(folder, True)
    summed = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x))
    held = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").agg(F.sum(F.size("ids")).alias("n"), *[summed(f"{f}_lengths").alias(f) for f in FIELDS]).first()
    n = held["n"] or 0
    told = [(f, n, held[f] / n if n else 0.0, shards) for f in FIELDS] + [("path", n, 1.0, shards)]
    spark.createDataFrame(told, _STATS).coalesce(1).write.parquet(f"{path}/stats")


@dataclass
class Clause:
    """Terms with their offsets, looked for in fields; one term is a phrase of length 1."""

    terms: list[tuple[int, str]]
    fields: tuple[str, ...]


def clauses(spark: SparkSession, query: str) -> list[Clause]:
    """A query's clauses: quoted parts are phrases, other words terms; where quotes do not balance, all words are terms.

    A quoted part, and each word outside, may also be a whole path.
    """
    parts = query.split('"')
    if len(parts) % 2 == 0:  # an odd number of quotes
        parts = [" ".join(parts)]
    phrases, plain = [p for p in parts[1::2] if p.strip()], " ".join(parts[0::2])
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([plain, *phrases])], "i int, p string").select("i", placed_terms(F.col("p")).alias("t")).collect()  # the query's own parts
    held = {r["i"]: [(t["at"], t["term"]) for t in r["t"]] for r in rows}
    found = [Clause([(0, t)], FIELDS) for t in sorted({t for _, t in held[0]})]
    found += [Clause([(at - own[0][0], t) for at, t in own], FIELDS) for i in range(1, len(phrases) + 1) if (own := held[i])]
    return found + [Clause([(0, w)], ("path",)) for w in sorted({*plain.split(), *phrases})]


def _wanted(spark: SparkSession, found: list[Clause]) -> DataFrame:
    """clause, size, term, offset, field: one row for each term of a clause and field."""
    rows = [(i, len(c.terms), t, at, f) for i, c in enumerate(found) for at, t in c.terms for f in c.fields]
    return spark.createDataFrame(rows, "clause int, size int, term string, offset int, field string")


def phrase_matches(postings: DataFrame, wanted: DataFrame, chunk: tuple[str, str] = ("path", "chunk_id")) -> DataFrame:
    """clause, path, chunk_id, field, length, tf: where all terms of a clause stand at their offsets, and how often.

    wanted has clause, size, term, offset, field.  Terms meet on the chunk (its two columns) and field; the places minus
    the offsets that all of them share are the starts.
    """
    hits = postings.join(wanted, ["term", "field"]).select("clause", "size", "offset", *chunk, "field", "length", "positions")
    starts = F.transform("positions", lambda p: p - F.col("offset"))
    met = hits.select("clause", "size", *chunk, "field", "length", F.struct("offset", starts.alias("starts")).alias("e"))
    met = met.groupBy("clause", "size", *chunk, "field", "length").agg(F.collect_list("e").alias("e")).where(F.size("e") == F.col("size"))
    shared = F.aggregate(F.slice("e", F.lit(2), F.size("e")), F.col("e")[0]["starts"], lambda held, x: F.array_intersect(held, x["starts"]))
    return met.select("clause", *chunk, "field", "length", F.size(shared).cast("long").alias("tf")).where("tf > 0")


def _part(idf: Column, tf: Column, length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean_length")))


def search(spark: SparkSession, path: str, query: str, limit: int = 10) -> DataFrame:
    """path, chunk_id, score of the best chunks for a query: BM25 summed over clauses and fields."""
    none = spark.createDataFrame([], "path string, chunk_id string, score double")
    found = clauses(spark, query)
    if not found:
        return none
    stats = spark.read.schema(_STATS).parquet(f"{path}/stats").coalesce(1)
    shards = stats.first()["shards"]
    terms = sorted({t for c in found for _, t in c.terms})
    own = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(shard_of("t", shards)).distinct().collect()]
    mine = F.col("shard").isin(*own) & F.col("term").isin(*terms)
    wanted = F.broadcast(_wanted(spark, found))  # the query's terms
    heads = written(spark.read.schema(f"{_HEADS}, shard int").parquet(f"{path}/postings").where(mine).join(wanted, ["term", "field"]), "heads")
    # idf of a clause and field: the sum of its terms'; without one of them there is no match
    df = heads.groupBy("clause", "size", "field", "term", "offset").agg(F.sum("n").alias("df")).join(F.broadcast(stats), "field")
    idf = df.groupBy("clause", "size", "field", "mean_length").agg(F.count(F.lit(1)).alias("known"), F.sum(F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    weights = F.broadcast(written(idf.where("known = size").select("clause", "field", "mean_length", "idf"), "weights"))  # clauses times fields
    # a phrase occurs at most as often as its rarest term
    tops = heads.groupBy("clause", "size", "field", "block").agg(F.count(F.lit(1)).alias("known"), F.min("most").alias("most"), F.max("least").alias("least")).where("known = size")
    bounds = tops.join(weights, ["clause", "field"]).groupBy("block").agg((F.sum(_part(F.col("idf"), F.col("most"), F.col("least"))) * SLACK).alias("bound"))
    bounds = written(bounds, "bounds")
    postings = spark.read.schema(f"{_POSTINGS}, shard int").parquet(f"{path}/postings").where(mine)
    names = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").select("block", "paths", "ids")
    own_names = F.transform("ids", lambda x, i: F.struct(i.alias("chunk"), F.get("paths", i).alias("path"), x.alias("chunk_id")))

    def scored(lists: DataFrame, named: DataFrame) -> DataFrame:
        met = phrase_matches(_by_chunk(lists), wanted, ("block", "chunk")).join(weights, ["clause", "field"])
        sums = met.groupBy("block", "chunk").agg(F.sum(_part(F.col("idf"), F.col("tf"), F.col("length"))).alias("score"))
        return sums.join(named.select("block", F.inline(own_names)), ["block", "chunk"]).select("path", "chunk_id", "score")

    ahead = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
    if not ahead:
        return none
    early = F.col("block").isin(*ahead)
    first = written(top(scored(postings.where(early), names.where(early)), limit, "chunk_id"), "first")
    kth, n = first.agg(F.min("score"), F.count(F.lit(1))).first()
    rest = bounds.where(~early & (F.col("bound") >= (kth if n >= limit else 0.0))).select("block")
    few = rest.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    in_rest = lambda df: df.join(F.broadcast(rest) if few else rest, "block", "left_semi")
    return top(first.unionByName(scored(in_rest(postings), in_rest(names))), limit, "chunk_id")


def text_results(chunks: DataFrame, path: str, query: str, limit: int = 10) -> DataFrame:
    """search() with the columns of a result; the contents of the best chunks only are read."""
    spark = chunks.sparkSession
    best = search(spark, path, query, limit)
    words = _strings(query_words(spark, query))
    found = chunks.join(F.broadcast(best), ["path", "chunk_id"])  # limit rows
    done = found.select("path", "chunk_id", "kind", "title", snippet("content", words).alias("snippet"), "start_line", "end_line", F.col("score").alias("text_score"), F.lit(0.0).alias("vector_score"), "score")
    return top(done, limit, "chunk_id")
