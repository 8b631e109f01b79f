"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays, a batch of texts at a time and without a
regular expression.  A table gives each code point its class (letter, number,
white space, other); with one or two code points of lookahead a class becomes a
kind, and each kind is a transition function of a small automaton whose states
say which sort of slice is open.  Composition of functions is associative, so the
state before every code point comes from a prefix scan: the functions that can
arise are few, are numbered, and compose by one table.  The first code point of a
text takes a function that forgets the state, so one scan runs over many texts.
A kind and the state before it tell whether a slice starts there.

Slices are looked up in a bounded cache of merged slices; a new slice is merged by
rank, the lowest first and the leftmost of equals: the short ones of a batch
together, as rows of an array, a long one with a heap, in n log n steps.  Each token keeps its byte offset in the
text, and decoding gathers the tokens' bytes from one table.

A text is encoded where it lies: there is no shuffle, and memory follows the
largest text.  A rank file (path as a parameter) must lie at its path on every
node; the classes are those of the tokenizer library's own Unicode tables.

Defined results: a null or empty text has no tokens; bytes that are not UTF-8 are
read as U+FFFD; repeated rows are rows of their own; ids of any type and null ids
pass through; an empty table gives no rows.  Of the columns only the id and the
text are read, so extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, small_batches

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Slices, and bytes of slices, that a worker's cache keeps between batches.
CACHED_SLICES, CACHED_BYTES = 400_000, 32 << 20
#: Up to so many bytes slices are merged together as rows of an array, this many at a time; beyond, one by one with a heap.
SHORT, MERGED_TOGETHER = 24, 8192
NO_RANK = np.iinfo(np.int32).max
#: Columns of a block of the scan.
BLOCK = 128

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE = range(4)
# Kinds: a class with its lookahead.  BODY is white space that more white space or the end follows, LAST is other white
# space, LAST_BLANK a last U+0020; QUOTE_1 and QUOTE_2 are apostrophes that a contraction of one or two letters follows.
K_OTHER, K_LETTER, K_NUMBER, K_BODY, K_LAST_BLANK, K_LAST, K_QUOTE_1, K_QUOTE_2 = range(8)
KINDS = 8
# States: what is open before a code point.  BLANK is a lone U+0020 that the next slice takes in; TWO and ONE are
# contractions that still wait for letters.
S_NONE, S_LETTERS, S_NUMBERS, S_OTHERS, S_SPACES, S_BLANK, S_TWO, S_ONE = range(8)
STATES = 8


def _step(kind: int, state: int) -> tuple[int, bool]:
    """(state after, whether a slice starts here) of the automaton."""
    if kind == K_LETTER:
        if state == S_TWO:
            return S_ONE, False
        if state == S_ONE:
            return S_NONE, False
        return S_LETTERS, state not in (S_LETTERS, S_BLANK)
    if kind == K_NUMBER:
        return S_NUMBERS, state not in (S_NUMBERS, S_BLANK)
    if kind == K_BODY:
        return S_SPACES, state != S_SPACES
    if kind == K_LAST_BLANK:
        return S_BLANK, True
    if kind == K_LAST:
        return S_NONE, True
    if kind == K_OTHER or state in (S_OTHERS, S_BLANK):  # an apostrophe within or behind a blank begins no contraction
        return S_OTHERS, state not in (S_OTHERS, S_BLANK)
    return (S_ONE if kind == K_QUOTE_1 else S_TWO), True


class Scanner:
    """The automaton's functions, numbered, with their table of composition."""

    def __init__(self):
        steps = [[_step(k, s) for s in range(STATES)] for k in range(KINDS)]
        functions = [tuple(s for s, _ in row) for row in steps]
        functions += [(f[S_NONE],) * STATES for f in functions]  # kind + KINDS: the first code point of a text
        identity = tuple(range(STATES))
        found, queue = {identity: 0}, [identity]
        while queue:
            f = queue.pop()
            for g in functions:
                both = tuple(g[s] for s in f)
                if both not in found:
                    found[both] = len(found)
                    queue.append(both)
        self.size = len(found)
        listed = list(found)
        self.of_kind = np.array([found[f] for f in functions], np.int32)
        self.then = np.array([found[tuple(g[s] for s in f)] for f in listed for g in listed], np.int32)  # f, then g
        self.acts = np.array(listed, np.int32).ravel()
        self.starts = np.array([b for row in steps for _, b in row])

    def _compose(self, f, g):
        return self.then.take(f * self.size + g)

    def _prefixes(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of f as columns, each with its prefix compositions, and the composition of all blocks before each."""
        blocks = -(-len(f) // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.int32)
        padded[: len(f)] = f
        held = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        for j in range(1, BLOCK):
            held[j] = self._compose(held[j - 1], held[j])
        totals = held[-1]
        if blocks == 1:
            return held, np.zeros(1, np.int32)
        inner, before = self._prefixes(totals)
        whole = self._compose(before[None, :], inner).T.ravel()[:blocks]
        return held, np.concatenate([np.zeros(1, np.int32), whole[:-1]])

    def boundaries(self, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where slices start; first marks the first code point of each text."""
        if not len(kinds):
            return np.zeros(0, bool)
        inner, before = self._prefixes(self.of_kind.take(kinds + KINDS * first.astype(np.int32)))
        entry = self.acts.take(before * STATES + S_NONE)  # the state before each block
        after = self.acts.take(inner * STATES + entry[None, :]).T.ravel()[: len(kinds)]
        state = np.concatenate([np.zeros(1, np.int32), after[:-1]])
        state[first] = S_NONE
        return self.starts.take(kinds * STATES + state)


@functools.cache
def scanner() -> Scanner:
    return Scanner()


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point, asked of the tokenizer library: which code points single-class patterns let through."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


#: Contractions, as the split pattern names them (fixed values).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def kinds_of(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The kind of each code point; last marks the last one of each text."""
    classes = class_table().take(points)
    kinds = np.array([K_OTHER, K_LETTER, K_NUMBER, K_LAST], np.int32).take(classes)
    space = classes == SPACE
    then_space = np.append(space[1:], True) | last
    kinds[space & (points == 0x20)] = K_LAST_BLANK
    kinds[space & then_space] = K_BODY
    quotes = np.flatnonzero((points == 0x27) & ~last)
    if len(quotes):
        one = points[quotes + 1]
        short = np.isin(one, [ord(c) for c in ONE_LETTER])
        kinds[quotes[short]] = K_QUOTE_1
        more = quotes[~short & ~last[quotes + 1]]
        for pair in TWO_LETTERS:
            kinds[more[(points[more + 1] == ord(pair[0])) & (points[more + 2] == ord(pair[1]))]] = K_QUOTE_2
    return kinds


def slices(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets where slices start; text i of raw (valid UTF-8) is raw[bounds[i]:bounds[i + 1]]."""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    begins = bounds[:-1][bounds[1:] > bounds[:-1]]
    first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
    at = np.searchsorted(lead, begins)
    first[at] = True
    if len(points):
        last[np.append(at[1:], len(points)) - 1] = True
    return lead[scanner().boundaries(kinds_of(points, last), first)]


class Vocabulary:
    """Ranks of a file of (base64 token, rank) lines, tokens' bytes as one table, and the cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if any(bytes([i]) not in self.ranks for i in range(256)) or len(self.ranks) < 257:
            raise ValueError(f"{path}: a byte-level vocabulary holds every single byte and some merge")
        self.size = max(self.ranks.values()) + 1
        held = [b""] * self.size
        for token, rank in self.ranks.items():
            held[rank] = token
        self.lengths = np.array([len(t) for t in held], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(held), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rank, splits = self.ranks.get, []
        for token, merged in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = rank(token[:cut]), rank(token[cut:])
                if left is not None and right is not None:
                    splits.append((left * self.size + right, merged))
        splits = np.array(sorted(splits), np.int64).reshape(-1, 2)
        self.pairs, self.pair_ranks = splits[:, 0].copy(), splits[:, 1].astype(np.int32)
        self._forget()

    def _forget(self) -> None:
        self.cache = _Merged()

    def add(self, pieces) -> None:
        """Puts new slices into the cache: known tokens as they are, short slices merged together, long ones one by one."""
        short = []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                self.cache.put(piece, (whole,))
            elif len(piece) <= SHORT:
                short.append(piece)
            else:
                self.cache.put(piece, self._merge_long(piece))
        short.sort(key=len)
        for at in range(0, len(short), MERGED_TOGETHER):
            some = short[at : at + MERGED_TOGETHER]
            for piece, ids in zip(some, self._merge_short(some)):
                self.cache.put(piece, ids)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two adjacent parts, NO_RANK where they are no token or the right one is none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs.take(at) == keys), self.pair_ranks.take(at), NO_RANK)

    def _merge_short(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many slices: each round merges the lowest, leftmost pair of every slice that still has one."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max()) + 1  # the last column stays empty
        inside = np.arange(width) < lengths[:, None]
        parts = np.full(inside.shape, -1, np.int32)
        parts[inside] = self.single.take(np.frombuffer(b"".join(pieces), np.uint8))
        ranks = np.full(parts.shape, NO_RANK, np.int32)
        ranks[:, :-1] = self._pair_ranks(parts[:, :-1], parts[:, 1:])
        done, rows, columns = parts.copy(), np.arange(len(pieces)), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            ends = best == NO_RANK
            done[rows[ends]] = parts[ends]
            rows, parts, ranks, at, best = rows[~ends], parts[~ends], ranks[~ends], at[~ends], best[~ends]
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, moved, 1), np.take_along_axis(ranks, moved, 1)
            here = np.arange(len(rows))
            parts[here, at] = best
            ranks[here, at] = self._pair_ranks(best, parts[here, at + 1])
            behind = np.flatnonzero(at)
            ranks[behind, at[behind] - 1] = self._pair_ranks(parts[behind, at[behind] - 1], best[behind])
        return [row[:n].tolist() for row, n in zip(done, (done >= 0).sum(axis=1).tolist())]

    def _merge_long(self, piece: bytes) -> list[int]:
        """A heap of pairs by (rank, place); a pair is stale where its parts have changed since."""
        rank, n = self.ranks.get, len(piece)
        following, previous = array("q", range(1, n + 2)), array("q", range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            middle = following[i]
            if middle < n and (r := rank(piece[i : following[middle]])) is not None:
                heapq.heappush(heap, (r, i, following[middle]))

        while heap:
            _, i, end = heapq.heappop(heap)
            middle = following[i]
            if middle < 0 or middle >= n or following[middle] != end:
                continue
            following[i], following[middle] = end, -1  # the part at middle is gone
            if end < n:
                previous[end] = i
            offer(i)
            if i:
                offer(previous[i])
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : following[i]]])
            i = following[i]
        return ids

    def encode(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and byte offsets (within its text) of every token, and the number of tokens before each text, of texts as in slices()."""
        if len(self.cache) > CACHED_SLICES or self.cache.bytes > CACHED_BYTES:
            self._forget()
        starts = slices(raw, bounds)
        edges = starts.tolist() + [len(raw)]
        pieces = [raw[a:b] for a, b in zip(edges, edges[1:])]
        self.add(set(pieces).difference(self.cache))
        which = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        ids, counts = self.cache.ids_of(which)
        before = np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)]
        lengths = self.lengths.take(ids)
        offsets = np.cumsum(lengths) - lengths - np.repeat(bounds[:-1], np.diff(before))
        return ids, offsets, before

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, in parts of a million."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.size):
            raise ValueError("an id is not in the vocabulary")
        parts = []
        for at in range(0, len(ids), 1 << 20):
            some = ids[at : at + (1 << 20)]
            n = self.lengths.take(some)
            parts.append(self.bytes.take(np.repeat(self.begins.take(some) - (np.cumsum(n) - n), n) + np.arange(n.sum())).tobytes())
        return b"".join(parts)


class _Merged(dict):
    """Slice to its number; the ids of a slice are one run of an array."""

    def __init__(self):
        super().__init__()
        self.flat, self.cuts, self.bytes = array("I"), array("q", [0]), 0

    def put(self, piece: bytes, ids) -> None:
        self[piece] = len(self.cuts) - 1
        self.flat.extend(ids)
        self.cuts.append(len(self.flat))
        self.bytes += len(piece)

    def ids_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered slices, one after the other, and how many each has."""
        cuts = np.array(self.cuts, np.int64)
        first = cuts.take(which)
        counts = cuts.take(which + 1) - first
        places = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.array(self.flat, np.uint32).take(places), counts


@functools.cache
def load(path: str) -> Vocabulary:
    """The vocabulary of a file; a worker reads it once."""
    return Vocabulary(path)


def contiguous(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of an array of strings, as valid UTF-8, and the bounds of each; null is empty."""
    raw = [b"" if not t.is_valid else t.as_buffer().to_pybytes() for t in texts]
    joined = b"".join(raw)
    try:
        joined.decode("utf-8")
    except UnicodeDecodeError:
        raw = [r.decode("utf-8", "replace").encode() for r in raw]
        joined = b"".join(raw)
    return joined, np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of a numeric array, as little-endian bytes."""
    data = np.ascontiguousarray(values)
    cuts = np.ascontiguousarray(bounds * data.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The id column, n_tokens, token_ids and token_offsets of each row.

    token_ids and token_offsets are little-endian unsigned 32-bit integers; an offset is that of the token's first
    byte in the UTF-8 text.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        words = load(vocabulary)
        for batch in arrow_batches(batches, 2 << 20):
            ids, offsets, before = words.encode(*contiguous(batch.column(1)))
            columns = [batch.column(0), pa.array(np.diff(before)), binaries(ids.astype("<u4"), before), binaries(offsets.astype("<u4"), before)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "token_ids", "token_offsets"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, token_ids binary, token_offsets binary")


def decode(encoded: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns of encoded with decoded, the bytes of its token_ids; null ids give null.  A column decoded of the input is replaced."""
    small_batches(encoded.sparkSession)
    rows = encoded.drop("decoded")
    place = rows.columns.index("token_ids")

    def run(batches):
        words = load(vocabulary)
        for batch in arrow_batches(batches, 2 << 20):
            found = [words.decode(np.frombuffer(t.as_buffer(), "<u4")) if t.is_valid else None for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def unsigned_at(c, i) -> Column:
    """The i-th (from 0) little-endian unsigned 32-bit integer of a binary column."""
    digits = F.hex(F.substring(c, i * 4 + 1, F.lit(4)))
    return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def tokens_between(encoded: DataFrame, begin: int, end: int) -> DataFrame:
    """The id column, token, offset of the tokens that start in bytes [begin, end) of each text: what the offsets are kept for."""
    rows = encoded.select(encoded.columns[0], "token_ids", "token_offsets", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n_tokens") - 1, F.lit(0)))).alias("i", "_"))
    rows = rows.where(F.octet_length("token_ids") > F.col("i") * 4)
    return rows.select(encoded.columns[0], unsigned_at("token_ids", F.col("i")).alias("token"), unsigned_at("token_offsets", F.col("i")).alias("offset")).where((F.col("offset") >= begin) & (F.col("offset") < end))


def encoding_report(docs: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, by encoding it and decoding the ids."""
    done = decode(encode(docs, vocabulary=vocabulary).drop("token_offsets"), vocabulary=vocabulary)
    return done.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
