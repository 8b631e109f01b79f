"""Optional text embedding by an ONNX model: masked mean of the hidden states, as a unit vector.

The model file has its tokenizer.json beside it.  Without a model, or where it
fails on a text, the hash embedding stands in.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col
from .vectors import embed

#: Tokens of a text that the model sees (fixed value).
MOST_TOKENS = 256
_sessions: dict = {}


def available(model_path: str | None) -> bool:
    return bool(model_path) and os.path.isfile(model_path) and os.path.isfile(os.path.join(os.path.dirname(model_path), "tokenizer.json"))


def _session(model_path: str):
    if model_path not in _sessions:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(os.path.join(os.path.dirname(model_path), "tokenizer.json"))
        tokenizer.enable_truncation(MOST_TOKENS)
        _sessions[model_path] = onnxruntime.InferenceSession(model_path), tokenizer
    return _sessions[model_path]


def mean_pool(hidden, mask):
    """Unit vector of the mean of hidden states (tokens x width) where mask is 1; a zero vector stays."""
    import numpy as np

    weight = np.asarray(mask, dtype=np.float64)[:, None]
    v = (np.asarray(hidden, dtype=np.float64) * weight).sum(axis=0) / max(weight.sum(), 1.0)
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else v


def embed_with(model_path: str | None, text) -> Column:
    """Embedding of a text by the model, or the hash embedding."""
    if not available(model_path):
        return embed(text)

    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        try:
            session, tokenizer = _session(model_path)
        except Exception:  # as does a model that does not load
            return batch.map(lambda x: None)
        wanted = [i.name for i in session.get_inputs()]

        def one(x):
            if x is None:
                return None
            try:
                found = tokenizer.encode(x)
                given = {"input_ids": found.ids, "attention_mask": found.attention_mask, "token_type_ids": found.type_ids}
                out = session.run(None, {k: np.array([v], dtype=np.int64) for k, v in given.items() if k in wanted})[0]
                return mean_pool(out[0], found.attention_mask) if out.ndim == 3 else None
            except Exception:  # a text that the model cannot take is embedded by hash
                return None

        return batch.map(one)

    return F.coalesce(F.pandas_udf(run, "array<double>")(col(text)), embed(text))
