"""Training-order materialisation: token-id shards in the order of a keyed permutation.

A Parquet source is tokenised once (byte-level BPE; the vocabulary's path is a
parameter, and the file must lie there on every node) into a written table of
documents' ids.  A document's ids and an end mark are cut into sequences of
``seq_len`` ids, the last padded.  Sequences are numbered exactly: each task
counts its own, and the tasks' totals give offsets.  A keyed Feistel network with
cycle-walking permutes [0, n), n being the number of sequences: a sequence's slot
is the permuted number, and the inverse leads from a slot to its sequence.

Ranges of ``width`` slots are shards, all full but the last: partition s holds
shard s in order and writes it as fixed-stride binary records, so slot k lies at
byte (k mod width) * stride of shard k div width, and a reader can resume anywhere.
The width follows from the total, so that shards hold SHARD_BYTES, about, and
there are MOST_SHARDS at most.  Shards are written in WAVES, a range of them each,
whose shuffle files go when the wave is done: disk holds the table of ids, the
shards and one wave.  A record is a header (flag, doc id, piece, number of ids),
the ids, and a line feed, which is the text writer's separator; that writer
commits a job atomically on any Hadoop file system.  The manifest is one row:
slots, width, seq_len, stride, vocabulary size, key, rounds.

Defined results: null and empty texts give no sequence; a null document id is
kept as null; ids must be whole numbers (another type raises TypeError); repeated
rows give sequences of their own; an empty table gives an archive without shards.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import NO_SHUFFLE_LEFT, arrow_batches, bounded_join, materialize, release, settings, shared_path, small_batches, whole_numbers

SEQ_LEN = 256
#: Bytes of a shard, about, and shards at most (beyond, shards grow).
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 18
#: Jobs that write the shards; each reads the table of ids and shuffles its part of it.
WAVES = 5
KEY = 0x5EED_2024
ROUNDS = 6
#: Tasks up to which the table of their offsets is broadcast (16 bytes each), and groups that it is summed in.
BROADCAST_TASKS, GROUPS = 2_000_000, 1024
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual split pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White-space characters in a row from which a text goes to the array tokeniser.
LONG_RUN = 50_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Feistel:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        rng = np.random.default_rng(key)
        self.keys = rng.integers(0, 1 << 63, rounds, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _round(self, right, key):
        x = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x, keys, back=False):
        left, right = x >> self.half, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << self.half) | right

    def _walk(self, x, keys, back):
        x = np.asarray(x, dtype=np.uint64)
        out = self._once(x, keys, back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slot(self, index) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


class Vocabulary:
    """Byte-level BPE of a rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype(id_type_of(self.end + 1))
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.path = path

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; one with a long run of white space, on which the pattern's back-tracking overflows, is cut by the array tokeniser."""
        if len(text) > LONG_RUN and _RUN.search(text):
            raw = text.encode("utf-8", "replace")
            return bpe.load(self.path).encode(raw, np.array([0, len(raw)]))[0].astype(self.kind)
        return np.array(self.encoding.encode_ordinary(text), self.kind)


_vocabularies: dict[str, Vocabulary] = {}


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; a worker reads it once."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def record_dtype(seq_len: int, id_type: str) -> np.dtype:
    """One record; its size is the stride."""
    return np.dtype([("flag", "u1"), ("doc_id", "<i8"), ("piece", "<u4"), ("n_tokens", "<u4"), ("tokens", id_type, (seq_len,)), ("end", "u1")])


def id_type_of(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def _tokenise(vocabulary: str, seq_len: int):
    """(id, text) to (id, task, first, m, ids): first is the number of sequences before in the task, m that of the text."""

    def run(batches):
        words, task, first = load_vocabulary(vocabulary), TaskContext.get().partitionId(), 0
        for batch in arrow_batches(batches, 2 << 20):
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid or not text.as_buffer().size:
                    continue
                ids = np.append(words.encode(text.as_py()), words.kind.type(words.end))
                m = -(-len(ids) // seq_len)
                rows.append((id_, task, first, m, ids.tobytes()))
                first += m
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "task", "first", "m", "ids"])

    return run


def _task_offsets(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(task, before): sequences of the tasks before it; and their total.  Summed by groups of tasks, so no task sees all of them."""
    own = tokens.groupBy("task").agg(F.sum("m").alias("n")).withColumn("group", F.col("task") % GROUPS)
    groups = own.groupBy("group").agg(F.sum("n").alias("n")).collect()  # GROUPS rows at most
    ahead, total = {}, 0
    for r in sorted(groups):
        ahead[r["group"]] = total
        total += r["n"]
    if not ahead:
        return own.select("task", F.lit(0).cast("long").alias("before")), 0
    earlier = Window.partitionBy("group").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*[F.lit(x) for pair in ahead.items() for x in pair]), F.col("group"))
    return own.select("task", (base + F.coalesce(F.sum("n").over(earlier), F.lit(0))).cast("long").alias("before")), total


def _place(kind: np.dtype, pad: int, seq_len: int, n: int, key: int, low: int, high: int):
    """(id, index, m, ids) to (slot, record) of the slots in [low, high)."""

    def run(batches):
        feistel, size = Feistel(n, key), kind.itemsize - 1  # the writer adds the line feed
        for batch in arrow_batches(batches, 2 << 20):
            m = batch.column(2).to_numpy()
            row = np.repeat(np.arange(len(m)), m)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            slot = feistel.slot(batch.column(1).to_numpy()[row] + piece)
            at = np.flatnonzero((slot >= low) & (slot < high))
            if not len(at):
                continue
            row, piece, slot = row[at], piece[at], slot[at]
            data = batch.column(3)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // kind["tokens"].base.itemsize
            flat = np.frombuffer(data.buffers()[2], kind["tokens"].base)
            begin = ends[row] + piece * seq_len
            held = np.minimum(ends[row + 1] - begin, seq_len)
            records = np.zeros(len(at), dtype=kind)
            places = begin[:, None] + np.arange(seq_len)
            inside = np.arange(seq_len) < held[:, None]
            records["tokens"] = np.where(inside, flat[np.minimum(places, len(flat) - 1)], pad)
            ids = batch.column(0)
            records["flag"] = ids.is_null().to_numpy(zero_copy_only=False)[row]
            records["doc_id"] = ids.fill_null(0).to_numpy()[row]
            records["piece"], records["n_tokens"] = piece, held
            raw = np.ascontiguousarray(records.view(np.uint8).reshape(len(records), kind.itemsize)[:, :size])
            cuts = np.arange(len(records) + 1, dtype=np.int32) * size
            value = pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(slot), value], names=["slot", "record"])

    return run


_MANIFEST = "n_slots long, width long, seq_len int, stride int, vocabulary_size long, key long, rounds int"


def write_training_order(
    spark: SparkSession, source: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, seq_len: int = SEQ_LEN, width: int | None = None, key: int = KEY, waves: int = WAVES
) -> None:
    """Writes the shards below path (shard=<number>/...) and their manifest (_manifest)."""
    small_batches(spark)
    rows = spark.read.parquet(source)
    whole_numbers(rows, id_col)
    words = load_vocabulary(vocabulary)
    kind = record_dtype(seq_len, words.kind.str)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = materialize(rows.mapInArrow(_tokenise(vocabulary, seq_len), "id long, task long, first long, m long, ids binary"), "order-tokens")
    offsets, n = _task_offsets(tokens)
    width = width or max(SHARD_BYTES // kind.itemsize, -(-n // MOST_SHARDS))
    shards = -(-n // width)
    offsets = materialize(offsets, "order-offsets")
    numbered = bounded_join(tokens, offsets, "task", BROADCAST_TASKS).select("id", (F.col("before") + F.col("first")).alias("index"), "m", "ids")
    step = -(-shards // max(1, min(waves, shards)))
    for first in range(0, shards, max(step, 1)):
        last = min(first + step, shards)
        placed = numbered.mapInArrow(_place(kind, words.end, seq_len, n, key, first * width, min(last * width, n)), "slot long, record binary")
        placed = placed.withColumn("shard", F.floor(F.col("slot") / width).cast("int"))
        placed = placed.repartitionById(last - first, (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "slot")
        with settings(spark, NO_SHUFFLE_LEFT):
            placed.select("shard", F.col("record").cast("string").alias("value")).write.mode("append").partitionBy("shard").option("lineSep", "\n").text(path)
    release(tokens, offsets)
    spark.createDataFrame([(n, width, seq_len, kind.itemsize, words.end + 1, key, ROUNDS)], _MANIFEST).coalesce(1).write.parquet(f"{path}/_manifest")


def read_training_order(spark: SparkSession, path: str) -> DataFrame:
    """One row per slot, read back from the shards: slot, shard, byte_offset, doc_id, piece, n_tokens, tokens_crc32."""
    told = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").first()
    kind = record_dtype(told["seq_len"], id_type_of(told["vocabulary_size"]))
    width, n_slots = told["width"], told["n_slots"]
    shape = "slot long, shard int, byte_offset long, doc_id long, piece long, n_tokens long, tokens_crc32 long"

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), dtype=kind)
                if len(data) != min(width, n_slots - shard * width) or (data["end"] != 10).any():
                    raise ValueError(f"shard {shard} is not whole")
                at = np.arange(len(data), dtype=np.int64)
                for part in range(0, len(data), 8192):
                    some = data[part : part + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(at[part : part + 8192] + shard * width),
                            pa.array(np.full(len(some), shard, np.int32)),
                            pa.array(at[part : part + 8192] * kind.itemsize),
                            pa.array(some["doc_id"].astype(np.int64), mask=some["flag"] == 1),
                            pa.array(some["piece"].astype(np.int64)),
                            pa.array(some["n_tokens"].astype(np.int64)),
                            pa.array([zlib.crc32(t.tobytes()) for t in some["tokens"]], pa.int64()),
                        ],
                        names=["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens", "tokens_crc32"],
                    )

    if not n_slots:
        return spark.createDataFrame([], shape)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("shard").cast("int").alias("shard"), "content").mapInArrow(run, shape)


def locate(slot: int, width: int, stride: int) -> tuple[int, int]:
    """(shard, byte offset) of a slot."""
    return slot // width, slot % width * stride


def read_slots(data: bytes, first: int, count: int, *, seq_len: int = SEQ_LEN, vocabulary_size: int = 50_257) -> np.ndarray:
    """Records [first, first + count) of a shard's bytes: what a resuming reader seeks to."""
    kind = record_dtype(seq_len, id_type_of(vocabulary_size))
    return np.frombuffer(data, dtype=kind, count=count, offset=first * kind.itemsize)


def training_order(spark: SparkSession, source: str) -> DataFrame:
    """Writes the whole source's shards to the shared folder and reads them back."""
    path = shared_path(spark, "training-order")
    write_training_order(spark, source, path)
    return read_training_order(spark, path)
