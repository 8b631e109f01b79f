"""Vectors as array<double> columns."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, tokens

#: Width of the hash embedding (fixed value).
DIMENSIONS = 64


def dot(a, b) -> Column:
    """Dot product; 0 where the lengths differ."""
    a, b = col(a), col(b)
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def magnitude(v) -> Column:
    return F.sqrt(F.aggregate(F.transform(col(v), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x))


def normalize(v) -> Column:
    """Unit vector; a zero vector stays."""
    v = col(v)
    size = magnitude(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def bucket(token: Column) -> Column:
    """Place of a token in the hash embedding: the first digest byte modulo the width."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 2), 16, 10).cast("int") % DIMENSIONS).cast("int")


def sign(token: Column) -> Column:
    """+1 where the ninth digest byte is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 18, 1), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def signed_buckets(text) -> Column:
    """array<int>: +(bucket + 1) or -(bucket + 1) for each token."""
    return F.transform(tokens(text), lambda t: sign(t) * (bucket(t) + 1))


def embed(text) -> Column:
    """Unit hash embedding of a text.  An Arrow batch is split, hashed and counted at once, each word only once."""
    return F.pandas_udf(_embed_batch, "array<double>")(col(text))


def embed_expression(text) -> Column:
    """The same without Python: for single texts, as it counts each of the places on its own."""
    places = signed_buckets(text)
    counted = F.transform(
        F.sequence(F.lit(1), F.lit(DIMENSIONS)),
        lambda i: (F.size(F.filter(places, lambda p: p == i)) - F.size(F.filter(places, lambda p: p == -i))).cast("double"),
    )
    return normalize(counted)


_WORD, _PLAIN_WORD = regex.compile(r"[\p{Alphabetic}\p{N}_]+"), re.compile(r"[A-Za-z0-9_]+")
_UPPER = re.compile("[A-Z]")
_CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@lru_cache(1 << 17)
def _places(word: str) -> list[int]:
    """Places of a word's tokens, its parts and itself; negative signs come after the positive ones."""
    if len(word) < 2 and len(word.encode()) < 2:
        return []
    parts = _CAMEL.sub("\x01", word).split("\x01") if _UPPER.search(word, 1) else [word]
    out = []
    for token in [*parts, word] if len(parts) > 1 else parts:
        digest = hashlib.sha256(token.lower().encode()).digest()
        out.append(digest[0] % DIMENSIONS + DIMENSIONS * (digest[8] % 2))
    return out if len(parts) > 1 else out * 2  # its only part is the word


def _embed_batch(batch: pd.Series) -> pd.Series:
    seen: dict[str, list[int]] = {}

    def one(x):
        if x is None:
            return None
        at: list[int] = []
        for word in (_PLAIN_WORD if x.isascii() else _WORD).findall(x):
            found = seen.get(word)
            if found is None:
                found = seen[word] = _places(word)
            at += found
        n = np.bincount(at, minlength=2 * DIMENSIONS).astype(np.float64) if at else np.zeros(2 * DIMENSIONS)
        v = n[:DIMENSIONS] - n[DIMENSIONS:]
        size = np.sqrt((v * v).sum())
        return v / size if size > 0 else v

    return batch.map(one)


def to_json(v) -> Column:
    return F.to_json(col(v))


def from_json(text) -> Column:
    """Array of numbers; null for text that is none."""
    return F.from_json(col(text), "array<double>")


def to_blob(v) -> Column:
    """Little-endian 32-bit floats."""
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        import numpy as np

        return values.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return pack(col(v))


def from_blob(b) -> Column:
    """The floats of a blob; null where its length is no multiple of 4."""
    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        import numpy as np

        return values.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4").tolist())

    return unpack(col(b))
