"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct five-word shingles, as sorted 64-bit
fingerprints.  Documents with equal sets form a class; one member stands for it.
A pair with Jaccard >= 0.8 shares a shingle among the first n - ceil(0.8 n) + 1
of each set in any fixed order (the order puts shingles that a bounded sample
finds frequent last; it never changes the result).  Classes that share such a
key, have compatible sizes and pass the signature test form regions.  A region is
cut by size into bands of bounded content, and each compatible pair of bands is
one tile, compared in one task.  The signature is a hashed parity bitmap, its
width following the set's size: differing bits bound the symmetric difference
from below, hence the overlap from above; pairs that may reach the threshold are
decided in the tiles by exact intersection of the sorted arrays.
Pairs already connected in a tile are skipped, since only components are asked
for; no link between components is lost.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of
fewer than five words is one shingle, its whole sequence; without words or text
the set is empty and linked with nothing (component_id is its own id).  Rows
that repeat an id are one node and each give a row.  A null id never names a
component.  Ids must be whole numbers (another type raises TypeError).  Extra
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_join, materialize, release, whole_numbers
from .components import Forest, connected_components, edge_batch

WORDS = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 4, 5
#: Documents, about, in which frequent shingles are looked for; shingles listed at most.
SAMPLE_DOCS, FREQUENT, FREQUENT_FROM = 4000, 50_000, 3
#: Content of a band: shingles plus this many for each document.
BAND_WEIGHT, ROW_WEIGHT = 200_000, 500
#: Classes of one block of a key.
KEY_BLOCK = 4096
#: Classes up to which the table of those to compare is broadcast (16 bytes each).
BROADCAST_ROWS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(64, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers))
        grown = np.full(size, 0x2545F4914F6CDD1D, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


_power_table(128)


#: Bytes of text that are hashed at once.
PIECE = 1 << 20


def _pieces(data: np.ndarray):
    """[start, end) pieces of about PIECE bytes that end where a word does."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        while end < n:
            space = _SPACE[data[end : end + 4096]]
            if space.any():
                end += int(space.argmax())
                break
            end = min(end + 4096, n)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i + 1]], and where each text's words begin."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _pieces(data):
        text = _LOWER[data[a:b]]
        word = ~_SPACE[text]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = offsets[(offsets >= a) & (offsets < b)] - a
        first[heads] = word[heads]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        at = np.arange(b - a, dtype=np.int32)
        within = at - np.maximum.accumulate(np.where(first, at, 0))
        within[~word] = 0
        value = (text.astype(np.uint64) + np.uint64(1)) * _power_table(int(within.max()))[within]
        value[~word] = 0
        hashes.append(_mix(np.add.reduceat(value, begin) * _MUL + np.uint64(1)))
        starts.append(begin + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """Yields the sorted distinct shingle fingerprints of each text."""
    words, begin = word_hashes(data, offsets)
    n = len(words) - WORDS + 1
    grams = np.zeros(0, np.uint64)
    if n > 0:
        grams = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            grams += words[k : k + n] * _PLACE[k]
        grams = _mix(grams)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= WORDS:
            own = np.sort(grams[a : b - WORDS + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield _mix(np.array([(words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def arrow_shingle_sets(column):
    """Shingle sets of the texts of an Arrow string column; a null's is empty."""
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    yield from shingle_sets(raw, offsets - offsets[0])


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def prefix_of(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the global order: those not listed as frequent, then the others."""
    p = prefix_length(len(own))
    for take in (2 * p, len(own)):
        head = own[:take]
        if not len(frequent):
            return head[:p]
        at = np.minimum(np.searchsorted(frequent, head), len(frequent) - 1)
        rare = head[frequent[at] != head]
        if len(rare) >= p:
            return rare[:p]
    common = own[frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own]
    return np.concatenate((rare, common))[:p]


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(arrays) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sampled_sets(batches):
    for batch in arrow_batches(batches):
        sets = [s for s in arrow_shingle_sets(batch.column(0)) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)], names=["digest", "grams"])


def frequent_shingles(documents: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles of several distinct documents of a sample; used for order only."""
    rows = documents.count()
    share = min(1_000_000, int(1_000_000 * SAMPLE_DOCS / max(rows, 1)) + 1)
    sample = documents.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < share).select(F.col(text_col))
    sets = sample.mapInArrow(_sampled_sets, "digest binary, grams array<long>").dropDuplicates(["digest"])
    counted = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    top = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _describe(frequent: np.ndarray):
    def run(batches):
        for batch in arrow_batches(batches):
            sizes, digests, prefixes, signs = [], [], [], []
            for own in arrow_shingle_sets(batch.column(1)):
                sizes.append(len(own))
                digests.append(_digest(own) if len(own) else None)
                prefixes.append(prefix_of(own, frequent) if len(own) else own)
                signs.append(signature(own).tobytes() if len(own) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(prefixes), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "prefix", "sign"])

    return run


def _shared(batches):
    """Of rows (key, n, rep) in order, those next to a row of the same key and a compatible size."""
    held, linked_before = None, False

    def rows(key, n, rep):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, n, rep)], names=["key", "n", "rep"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            now = [np.concatenate(([x], y)) for x, y in zip(held, now)]
        key, n, rep = now
        near = (key[1:] == key[:-1]) & (n[1:] * NUM <= n[:-1] * DEN)
        keep = np.concatenate(([linked_before and held is not None], near))
        keep[:-1] |= near
        yield rows(key[:-1][keep[:-1]], n[:-1][keep[:-1]], rep[:-1][keep[:-1]])
        held, linked_before = (key[-1], n[-1], rep[-1]), bool(near[-1]) if len(near) else linked_before
    if held is not None and linked_before:
        yield rows(*([x] for x in held))


def signature_bits(n: int) -> int:
    return 1 << min(14, max(8, (n - 1).bit_length()))


def signature(own: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit h is the number of shingles that hash to h, modulo 2."""
    bits = signature_bits(len(own))
    odd = (np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def may_link(total, apart):
    """Whether sets of ``total`` shingles together that differ in ``apart`` or more can reach the threshold."""
    return (total - apart) // 2 * (NUM + DEN) >= NUM * total


def _matrix(signs: list[np.ndarray], words: int) -> np.ndarray:
    """The signatures of that width, and those of twice the width folded to it; others stay empty."""
    out = np.zeros((len(signs), words), dtype=np.uint64)
    for i, sign in enumerate(signs):
        if len(sign) == words:
            out[i] = sign
        elif len(sign) == 2 * words:
            out[i] = sign[:words] ^ sign[words:]
    return out


def spanning_pairs(sizes: np.ndarray, signs: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, verify):
    """Yields (i, j) that join members, sorted by size, which label does not join yet.

    Pairs of compatible sizes that pass the signature test and verify(i, j) are joined; with side, only pairs of two sides.
    """
    m, matrices = len(sizes), {}
    ends = np.searchsorted(sizes * NUM, sizes * DEN, side="right")  # one past the last with 4 n_j <= 5 n_i
    for i in range(m - 1):
        others = np.arange(i + 1, ends[i])
        others = others[label[others] != label[i]]
        if side is not None and len(others):
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        words = len(signs[i])
        if words not in matrices:
            matrices[words] = _matrix(signs, words)
        bits = matrices[words]
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in others[may_link(sizes[i] + sizes[others], apart)].tolist():
            if label[j] != label[i] and verify(i, j):
                label[label == label[j]] = label[i]
                yield i, j


def _regions(batches):
    """Rows (key, low, high, side, n, rep, sign) in order: joins those of one tile of a key that may be linked."""
    forest = Forest()

    def flush(rows):
        label = np.array([forest.root(r[2]) for r in rows])
        if (label == label[0]).all():
            return
        side = np.array([r[0] for r in rows])
        signs = [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([r[1] for r in rows], dtype=np.int64)
        for i, j in spanning_pairs(sizes, signs, label, side if (side != side[0]).any() else None, lambda i, j: True):
            forest.join(rows[i][2], rows[j][2])

    held, rows = None, []
    for batch in batches:
        for key, low, high, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (key, low, high) != held:
                if len(rows) > 1:
                    flush(rows)
                held, rows = (key, low, high), []
            rows.append(row)
        if len(forest.parent) > 1_000_000:
            yield edge_batch(*forest.stars())
            forest = Forest()
    if len(rows) > 1:
        flush(rows)
    yield edge_batch(*forest.stars())


def _arrays(digest_at: int):
    """(tiles, rep, digest, text) to (tiles, rep, n, grams); rows whose text has another set than the class go."""

    def run(batches):
        for batch in arrow_batches(batches):
            keep, sets = [], []
            for own, want in zip(arrow_shingle_sets(batch.column(3)), batch.column(2).to_pylist()):
                ok = len(own) > 0 and _digest(own) == want
                keep.append(ok)
                if ok:
                    sets.append(own)
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], names=["tiles", "rep", "n", "grams"])

    return run


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, exactly."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both > 0 and both * (NUM + DEN) >= NUM * (len(a) + len(b))


def compare_tile(reps, sizes: np.ndarray, side: np.ndarray, sets: list[np.ndarray]):
    """Spanning links of one tile.  side: band of each member; pairs of two bands are compared, or all if one band."""
    order = np.lexsort((reps, sizes))
    sets = [sets[i] for i in order]
    side = side[order] if len(np.unique(side)) > 1 else None
    for i, j in spanning_pairs(sizes[order], [signature(x) for x in sets], np.arange(len(sets)), side, lambda i, j: linked(sets[i], sets[j])):
        yield int(reps[order[i]]), int(reps[order[j]])


def _tiles(batches):
    """Rows (tile, band, rep, n, grams), together by tile: the spanning links of each tile."""

    def flush(rows):
        if len(rows) < 2:
            return []
        return list(compare_tile(np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows], dtype=np.int64), np.array([r[0] for r in rows]), [r[2] for r in rows]))

    held, rows, links = None, [], []
    for batch in batches:
        tiles, bands, reps = (batch.column(i).to_pylist() for i in range(3))
        grams = batch.column(4)
        flat, offsets = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
        for i, tile in enumerate(tiles):
            if tile != held:
                links += flush(rows)
                held, rows = tile, []
            rows.append((bands[i], reps[i], flat[offsets[i] : offsets[i + 1]].copy()))
        if links:
            yield edge_batch(*zip(*links))
            links = []
    links += flush(rows)
    if links:
        yield edge_batch(*zip(*links))


def ngram_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    whole_numbers(documents, id_col)
    kind = documents.schema[id_col].dataType
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent = frequent_shingles(docs, "id", "text")
    sets = materialize(docs.mapInArrow(_describe(frequent), "id long, n long, digest binary, prefix array<long>, sign binary"), "jaccard-sets", "lz4")
    full = sets.where("n > 0 and id is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("k")), "jaccard-classes")
    # copies: members of a class that do not stand for it
    copies = full.select("id", "digest").join(classes.where("k > 1").select("digest", "rep"), "digest").where("id <> rep").select("id", "digest")
    copies = materialize(copies, "jaccard-copies")
    standing = bounded_join(full, copies, ["id", "digest"], BROADCAST_ROWS, "left_anti")
    entries = standing.select(F.explode("prefix").alias("key"), "n", F.col("id").alias("rep"))
    # a key of many classes is dealt into blocks before anything is sorted; each pair of blocks is a tile of its own
    hot = materialize(entries.groupBy("key").agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "jaccard-hot")
    tagged = bounded_join(entries, hot.select("key", F.lit(True).alias("many")), "key", BROADCAST_ROWS, "left")
    few = tagged.where("many is null").select("key", "n", "rep").repartition(F.col("key")).sortWithinPartitions("key", "n", "rep").mapInArrow(_shared, "key long, n long, rep long")
    shared = materialize(few.unionByName(tagged.where("many").select("key", "n", "rep")), "jaccard-shared")
    dealt = bounded_join(shared, hot, "key", BROADCAST_ROWS, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.hash("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "n", "rep")
    signed = dealt.join(standing.select(F.col("id").alias("rep"), "sign"), "rep").select("key", "low", "high", "side", "n", "rep", "sign")
    chained = signed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "rep").mapInArrow(_regions, "a long, b long")
    regions = connected_components(chained)
    release(shared, hot)
    regions = regions.unionByName(regions.select(F.col("root").alias("node"), "root").distinct())
    members = classes.select("rep", "n", "digest").join(regions, F.col("rep") == F.col("node")).select("rep", "n", "digest", "root")
    # bands of bounded content, by size: sizes are summed before they are ordered, and a size of much content is dealt out
    weight = F.col("k") * (F.col("n") + ROW_WEIGHT)
    held = members.groupBy("root", "n").agg(F.count("*").alias("k"))
    by_size = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("root", "n", F.floor(F.coalesce(F.sum(weight).over(by_size), F.lit(0)) / BAND_WEIGHT).cast("long").alias("first"), F.ceil(weight / BAND_WEIGHT).cast("int").alias("parts"))
    held = materialize(held, "jaccard-held")
    banded = bounded_join(members, held, ["root", "n"], BROADCAST_ROWS)
    banded = banded.select("rep", "n", "digest", "root", (F.col("first") + F.pmod(F.hash("rep"), F.col("parts"))).alias("band"))
    banded = materialize(banded, "jaccard-bands")
    bands = banded.groupBy("root", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    above = bands.select("root", F.col("band").alias("band2"), F.col("least").alias("least2"))
    tiles = bands.join(above, "root").where((F.col("band2") >= F.col("band")) & (F.col("least2") * NUM <= F.col("most") * DEN))
    tile = F.concat_ws(":", "root", "band", "band2")
    of_band = tiles.select("root", "band", tile.alias("tile")).unionByName(tiles.where("band2 > band").select("root", F.col("band2").alias("band"), tile.alias("tile")))
    of_band = of_band.groupBy("root", "band").agg(F.collect_list("tile").alias("tiles"))  # tiles of one band: bounded by its region's bands
    wanted = banded.join(of_band, ["root", "band"]).select(F.struct("band", "tiles").alias("tiles"), "rep", "digest")
    wanted = materialize(wanted, "jaccard-wanted")
    found = bounded_join(docs, wanted, F.col("id") == F.col("rep"), BROADCAST_ROWS).select("tiles", "rep", "digest", "text")
    arrays = found.mapInArrow(_arrays(2), "tiles struct<band:long,tiles:array<string>>, rep long, n long, grams array<long>")
    dealt = arrays.select(F.explode("tiles.tiles").alias("tile"), F.col("tiles.band").alias("band"), "rep", "n", "grams")
    links = dealt.repartition(F.col("tile")).sortWithinPartitions("tile", "rep").mapInArrow(_tiles, "a long, b long")
    # a repeated id is one node: it joins the classes that it is in
    ids = full.select("id", "digest").distinct()
    twice = ids.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    same = ids.join(twice, "id").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(links.unionByName(same))
    release(copies, held, banded, wanted)
    final = classes.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("root"))
    done = sets.select("id", "n", "digest").join(final, "digest", "left")
    return done.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").cast(kind).alias("component_id"))


def keep_one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id of each component (of rows that repeat an id, one); all columns."""
    found = materialize(ngram_components(documents, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("id"), "component_id"), "jaccard-found")
    leave = materialize(found.where("component_id < id").select(F.col("id").alias(id_col)).distinct(), "jaccard-leave")
    kept = bounded_join(documents, leave, id_col, BROADCAST_ROWS, "left_anti")
    twice = materialize(found.where("id is not null").groupBy(F.col("id").alias(id_col)).agg(F.count("*").alias("k")).where("k > 1").select(id_col), "jaccard-twice")
    if twice.limit(1).count():
        # xxhash64 takes no maps; their JSON stands in
        content = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in documents.schema]
        own = Window.partitionBy(id_col).orderBy(F.xxhash64(*content))
        again = bounded_join(kept, twice, id_col, BROADCAST_ROWS, "left_semi").select("*", F.row_number().over(own).alias("_nth of its id")).where("`_nth of its id` = 1")
        kept = bounded_join(kept, twice, id_col, BROADCAST_ROWS, "left_anti").select(*documents.columns).unionByName(again.select(*documents.columns))
    return kept.select(*documents.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
b AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
