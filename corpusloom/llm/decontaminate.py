"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Symbols are words.  Every window of a benchmark item (``window`` consecutive
words; an item of fewer words, but not none, is one window) is a test string.
Strings of one length share a searcher: a block shift table (two-word blocks,
hashed) says how far the search may jump, suffix-hash buckets hold the strings
that end in a block, and a direct comparison confirms each occurrence.

Defined results: a null or wordless text has no words and no hit; an item whose
text is null or wordless has no window; an item whose id is null hits words but is
not listed among the items; repeated rows of documents each give a row; repeated
items count once by id; ids must be whole numbers (another type raises TypeError);
extra columns of either table are not read.  The benchmark is shipped to the
executors in blocks of about ``block_bytes`` of text (an item is never cut, so one
above that is a block); each block is one pass, and a Python worker builds a
block's patterns once for all its tasks.  Of CHAIN passes the state is written out,
so a stage has a bounded number of workers.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, whole_numbers

WINDOW = 10
#: Most benchmark text in one block of patterns held by an executor's worker.
BLOCK_BYTES = 4 << 20
#: Blocks searched in one chain of workers before the state is written out.
CHAIN = 4

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return _WORD.findall(text.lower())


class WuManber:
    """Finds all occurrences of strings of one length m over integer symbols."""

    def __init__(self, strings, m: int):
        self.m, self.b = m, min(2, m)
        size = 1 << max(10, min(22, (len(strings) * m * 4).bit_length()))
        self.mask = size - 1
        far = m - self.b + 1
        shift, buckets = bytearray([min(far, 255)]) * size, {}
        for string in strings:
            for end in range(self.b, m + 1):
                h = self.block(string, end)
                shift[h] = min(shift[h], m - end, 255)
            buckets.setdefault(self.block(string, m), []).append(string)
        self.shift, self.buckets = shift, buckets

    def block(self, symbols, end: int) -> int:
        if self.b == 1:
            return symbols[end - 1] & self.mask
        return (symbols[end - 2] * 40503 + symbols[end - 1]) & self.mask

    def search(self, symbols: list[int], found) -> None:
        """Calls found(start, string) for each occurrence; symbols below 0 occur in no string."""
        m, n, shift, buckets, mask, b = self.m, len(symbols), self.shift, self.buckets, self.mask, self.b
        at = m - 1
        while at < n:
            last = symbols[at]
            if last < 0:
                at += m
                continue
            if b == 2:
                before = symbols[at - 1]
                if before < 0:
                    at += m - 1
                    continue
                h = (before * 40503 + last) & mask
            else:
                h = last & mask
            skip = shift[h]
            if skip:
                at += skip
                continue
            start = at - m + 1
            for string in buckets.get(h, ()):
                if string[0] == symbols[start] and list(string) == symbols[start : at + 1]:
                    found(start, string)
            at += 1


class Searcher:
    """The searchers of one block of items, one for each length of string."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            m = min(window, len(symbols))
            for i in range(len(symbols) - m + 1 if m else 0):
                owners = self.owners.setdefault(tuple(symbols[i : i + m]), set())
                if item is not None:
                    owners.add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for string in self.owners:
            by_length.setdefault(len(string), []).append(string)
        self.searchers = [WuManber(strings, m) for m, strings in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Merged [start, end) word spans that windows cover, and the items whose windows occur."""
        get = self.ids.get
        symbols, spans, items = [get(w, -1) for w in words], [], set()

        def found(start, string):
            spans.append((start, start + len(string)))
            items.update(self.owners[string])

        for searcher in self.searchers:
            searcher.search(symbols, found)
        return merge_spans(spans), items


_searchers: dict[tuple[str, int], Searcher] = {}


def searcher_of(name: str, items, window: int) -> Searcher:
    """The searcher of a block of items; a worker holds the last few that it built."""
    if (name, window) not in _searchers:
        while len(_searchers) >= CHAIN:
            _searchers.pop(next(iter(_searchers)))
        _searchers[name, window] = Searcher(items, window)
    return _searchers[name, window]


def merge_spans(spans) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


_STATE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


def _searching(items, window: int, last: bool):
    """A pass over the documents for one block of items; only a pass before the last keeps the text."""
    name = uuid.uuid4().hex

    def run(batches):
        searcher = searcher_of(name, items, window)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out = ([], [], [])
            for i in range(batch.num_rows):
                text = texts[i]
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                spans, found = searcher.search(words)
                old_spans, old_items = batch.column(3)[i].as_py() or [], batch.column(4)[i].as_py() or []
                if old_spans:
                    spans = merge_spans([*spans, *zip(old_spans[::2], old_spans[1::2])])
                out[0].append(len(words))
                out[1].append([x for span in spans for x in span])
                out[2].append(sorted(found.union(old_items)))
            kept = pa.nulls(batch.num_rows, pa.string()) if last else texts
            yield pa.RecordBatch.from_arrays(
                [ids, kept, pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64()))],
                names=_STATE.names,
            )

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Yields lists of (item_id, text): the stated query set, a bounded block at a time."""
    rows = (
        benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
        .where("text is not null")
        .distinct()
        .orderBy("item", "text")
    )
    block, held = [], 0
    for row in rows.toLocalIterator():
        text = row["text"].encode()
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row["item"], text))
        held += len(text)
    yield block


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, spans (flat [start, end) word offsets, merged), items (sorted ids)."""
    whole_numbers(documents, id_col)
    whole_numbers(benchmark, item_col)
    state = documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<bigint>").alias("items"),
    )
    held = None
    for n, block in enumerate(item_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if held is not None:
            state = state.mapInArrow(_searching(held, window, False), _STATE)
            if n % CHAIN == 0:
                state = materialize(state, "decontaminate")
        held = block
    state = state.mapInArrow(_searching(held, window, True), _STATE)
    return state.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def contamination_report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns of the contract, derived from find_contamination."""
    found = find_contamination(documents, benchmark, **options)
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    strings = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        options.get("id_col", "doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(strings, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs; all their columns, whatever these are."""
    names = documents.columns
    kept = documents
    for n, block in enumerate(item_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if n and n % CHAIN == 0:
            kept = materialize(kept, "decontaminate")
        kept = kept.mapInArrow(_clean(block, window, names.index(text_col)), documents.schema)
    return kept


def _clean(items, window: int, at: int):
    name = uuid.uuid4().hex

    def run(batches):
        searcher = searcher_of(name, items, window)
        for batch in batches:
            texts = batch.column(at)
            keep = [not (t.is_valid and searcher.search(words_of(t.as_buffer().to_pybytes()))[0]) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
dwin AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hits AS (SELECT rid, i, dwin.m AS m, item_id FROM dwin JOIN pat ON dwin.p = pat.p AND dwin.m = pat.m),
pos AS (SELECT rid, count(DISTINCT k) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
