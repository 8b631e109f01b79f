"""Language identification by error-correcting output codes.

Each language gets a codeword.  For each bit of the code a binary n-gram
classifier (hashed byte n-grams, naive Bayes log-odds between the languages
whose bit is 1 and those whose bit is 0) predicts the bit from the text.
Decoding sums a logistic loss over the bits, each weighted by how well its
classifier did on that language's sample, and takes the codeword with the least
loss; a small gap to the second flags the text as ambiguous.  A text whose least
loss is above the model's bound is far from every codeword: it is in no learned
language.  The bound lies halfway between the largest loss of the sample's
rightly decoded texts and log 2, the loss of a text that says nothing.

The classifiers learn from a bounded sample: about ``sample_per_language``
labelled texts of each label, drawn row by row (repeated rows are drawn each on
their own).  Every label is learned, unless a caller asks for the
``most_languages`` with the most rows.  N-grams are counted and turned into the
bits' weights by tasks that own buckets, so the driver holds 2^BITS rows of as many
numbers as the code has bits, which grow with the logarithm of the labels.  Only
the text is an input of a prediction.

Defined results: text null or without a letter gives ``und`` and score 0; a
table without labelled rows gives ``und`` everywhere; with one learned language
every text with a letter gets it.  Ties go to the language that sorts first.
Repeated rows each give a row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_join, materialize, release

UNKNOWN = "und"
#: Labelled texts of a language that are learned from, about.
SAMPLE_PER_LANGUAGE = 1500
#: Labels up to which the table of their sizes is broadcast.
BROADCAST_LABELS = 200_000
#: Cells of the table of losses that a task holds at a time: texts x labels x bits.
MOST_CELLS = 1 << 22
SEED = 20240607
ORDERS = (2, 3, 4)
BITS = 15
SMOOTHING = 0.5
#: Slope of the logistic loss over a text's mean log-odds.
SLOPE = 8.0
#: Gap of the mean weighted loss of the two best codewords under which a text is ambiguous.
AMBIGUOUS = 0.02

#: ASCII letters lower-cased, other ASCII as a space, bytes of other letters kept.
_FOLD = np.array([c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], dtype=np.uint32)
_PIECE = 1 << 16


def codewords(k: int) -> np.ndarray:
    """k codewords of +1/-1: the exhaustive code up to 6 languages, else the best of fixed random codes."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.int8)
    if k <= 6:
        n = 2 ** (k - 1) - 1
        rows = [[1] * n] + [[1 if (j // 2 ** (k - 1 - i)) % 2 else -1 for j in range(n)] for i in range(1, k)]
        return np.array(rows, dtype=np.int8)
    rng, best, far = np.random.default_rng(k), None, -1
    n = 6 * int(np.ceil(np.log2(k)))
    for _ in range(200 if k <= 256 else 4):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, n))
        if (np.abs(code.sum(axis=0, dtype=np.int64)) == k).any():
            continue
        wide = code.astype(np.float32)
        least = min(int((n - (wide[i] @ wide[i + 1 :].T).max()) // 2) for i in range(k - 1))
        if least > far:
            best, far = code, least
    return best


def ngram_buckets(text: np.ndarray):
    """Yields arrays of hashed n-gram buckets of a lower-cased UTF-8 text."""
    for at in range(0, max(1, len(text)), _PIECE):
        piece = text[max(0, at - max(ORDERS) + 1) : at + _PIECE]
        x = np.concatenate(([np.uint32(32)], _FOLD[piece], np.full(3, 32, np.uint32))).astype(np.uint32)
        n = len(x) - max(ORDERS) + 1
        gram = np.zeros(n, np.uint32)
        for order in range(1, max(ORDERS) + 1):
            gram = (gram << np.uint32(8)) | x[order - 1 : order - 1 + n]
            if order in ORDERS:
                yield ((gram + np.uint32(order * 0x1F123BB5)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _texts(column):
    """Byte arrays of the lower-cased texts of an Arrow column, None for nulls."""
    lower = pc.utf8_lower(column)
    data = lower.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(lower.type)
    offsets = np.frombuffer(lower.buffers()[1], np.int64 if wide else np.int32)[lower.offset : lower.offset + len(lower) + 1] if len(lower) else []
    valid = lower.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        yield raw[offsets[i] : offsets[i + 1]] if ok else None


def has_letter(column) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_pylist()


def _count(batches):
    """Rows (lang, bucket, n): n-grams of the sample, summed within a task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
            held = totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for b in ngram_buckets(text):
                held += np.bincount(b, minlength=1 << BITS)
    for lang, held in totals.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """Codewords, bit classifiers and decoding weights."""

    def __init__(self, languages: list[str], weights: np.ndarray | None = None):
        self.languages, self.code = languages, codewords(len(languages))
        #: Log-odds of each n-gram bucket and bit.
        self.weights = np.zeros((1 << BITS, self.code.shape[1]), np.float32) if weights is None else weights
        self.trust = np.ones(self.code.shape)
        self.bound = np.inf

    def log_odds(self, text: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for b in ngram_buckets(text):
            total += self.weights.take(b, axis=0).sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / max(n, 1)

    def losses(self, odds: np.ndarray) -> np.ndarray:
        """Loss of each language, from rows of log-odds: weighted mean of the logistic losses of its bits."""
        step = max(1, MOST_CELLS // self.code.size)
        parts = [np.logaddexp(0, -(odds[i : i + step, None, :] * self.code[None, :, :] * SLOPE)) * self.trust for i in range(0, len(odds), step)]
        return np.concatenate([p.sum(axis=2) for p in parts]) / np.maximum(self.trust.sum(axis=1), 1e-9)

    def predict(self, column) -> tuple[list, list, list, list]:
        """Language, score, ambiguity of each text of an Arrow column, and whether its loss is within the bound."""
        n = len(column)
        lang, score, doubt, near = [UNKNOWN] * n, [0.0] * n, [False] * n, [False] * n
        if not self.languages:
            return lang, score, doubt, near
        at = [i for i, ok in enumerate(has_letter(column)) if ok]
        if at:
            texts = list(_texts(column))
            loss = self.losses(np.array([self.log_odds(texts[i]) for i in at]))
            order = np.argsort(loss, axis=1, kind="stable")
            like = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
            like /= like.sum(axis=1, keepdims=True)
            for j, i in enumerate(at):
                best = order[j, 0]
                lang[i], score[i] = self.languages[best], float(like[j, best])
                doubt[i] = len(self.languages) > 1 and bool(loss[j, order[j, 1]] - loss[j, best] < AMBIGUOUS)
                near[i] = bool(loss[j, best] <= self.bound)
        return lang, score, doubt, near


def _bit_weights(languages: list[str], totals: dict[str, int]):
    """(lang, bucket, n), whole buckets a task, to (bucket, weights): log-odds of each bit, from each language's counts scaled to one total."""
    code = codewords(len(languages))
    mean = sum(totals.values()) / len(totals)
    scale = {k: mean / n for k, n in totals.items()}
    place = {k: i for i, k in enumerate(languages)}
    up, down = (code > 0).sum(axis=0), (code < 0).sum(axis=0)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, bucket, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                mine = held.setdefault(bucket, np.zeros((2, code.shape[1])))
                word = code[place[lang]]
                mine[0, word > 0] += n * scale[lang]
                mine[1, word < 0] += n * scale[lang]
        if held:
            found = [np.log((SMOOTHING + m[0] / up) / (SMOOTHING + m[1] / down)).tolist() for m in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["bucket", "weights"])

    return run


def _bit_hits(model: Model):
    """Rows (lang, hits, n): how often each bit's classifier was right on a language's sample."""

    def run(batches):
        hits = np.zeros(model.code.shape)
        seen = np.zeros(len(model.languages), np.int64)
        where = {name: i for i, name in enumerate(model.languages)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                k = where[lang]
                hits[k] += np.sign(model.log_odds(text)) == model.code[k]
                seen[k] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(model.languages, pa.string()), pa.array(hits.tolist(), pa.list_(pa.float64())), pa.array(seen, pa.int64())], names=["lang", "hits", "n"]
        )

    return run


def _largest_loss(model: Model):
    """A row (loss): the largest one of the texts that are decoded to their label."""

    def run(batches):
        most = 0.0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                loss = model.losses(model.log_odds(text)[None])[0]
                if model.languages[int(loss.argmin())] == lang:
                    most = max(most, float(loss.min()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["loss"])

    return run


def train(
    documents: DataFrame, *, where=None, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, most_languages: int | None = None, seed: int = SEED
) -> Model:
    """Learns from labelled rows (of those, the ones that meet the condition ``where``)."""
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = (rows.where(where) if where is not None else rows).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes if most_languages is None else sizes.orderBy(F.desc("size"), "lang").limit(most_languages), "language-sizes")
    known = bounded_join(rows, sizes, "lang", BROADCAST_LABELS)
    sample = materialize(known.where(F.rand(seed) < F.lit(float(sample_per_language)) / F.col("size")).select("lang", "text").repartition(8), "language-sample")
    counted = materialize(sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}  # a row a label
    release(sizes)
    if not totals:
        release(sample, counted)
        return Model([])
    languages = sorted(totals)
    where_is = {name: i for i, name in enumerate(languages)}
    model = Model(languages)
    if len(languages) > 1:
        owned = counted.repartition("bucket").mapInArrow(_bit_weights(languages, totals), "bucket int, weights array<double>")
        for bucket, weights in owned.toLocalIterator():  # 2^BITS rows at most, of a number a bit
            model.weights[bucket] = weights
    release(counted)
    hits, seen = np.zeros(model.code.shape), np.zeros(len(languages))
    for lang, h, n in sample.mapInArrow(_bit_hits(model), "lang string, hits array<double>, n long").collect():
        hits[where_is[lang]] += h
        seen[where_is[lang]] += n
    model.trust = (hits + 1) / (seen[:, None] + 2)
    most = sample.mapInArrow(_largest_loss(model), "loss double").agg(F.max("loss")).first()[0]
    model.bound = (min(most or 0.0, np.log(2)) + np.log(2)) / 2 + 1e-9
    release(sample)
    return model


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, ambiguous."""

    def run(batches):
        for batch in arrow_batches(batches):
            lang, score, doubt, _ = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    kind = documents.schema[id_col].dataType.simpleString()
    found = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return found.withColumnRenamed("id", id_col)


def is_held_out(id_col: str = "doc_id"):
    """Documents never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(documents: DataFrame, **options) -> DataFrame:
    """The contract's columns: learns from all but the held-out documents and predicts every document."""
    model = train(documents, where=~is_held_out() & F.col("doc_id").isNotNull(), **options)
    return identify(documents, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(documents: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are in a learned language: with a letter, and a loss within the bound.

    All columns stay; a null in the column of labels, where there is one of strings, becomes the predicted language.
    """
    at = documents.columns.index(text_col)
    label = documents.columns.index(lang_col) if lang_col in documents.columns and documents.schema[lang_col].dataType.typeName() == "string" else None

    def run(batches):
        for batch in arrow_batches(batches):
            lang, _, _, near = model.predict(batch.column(at))
            if label is not None:
                filled = pc.coalesce(batch.column(label), pa.array(lang, batch.column(label).type))
                batch = batch.set_column(label, batch.schema.field(label), filled)
            yield batch.filter(pa.array(near, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
