"""Slices, merges and ids against the tokenizer library, decoding by round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe

ALPHABET = ["'", "'s", "'re", "'ll", "'t", "'ve", "'m", "'d", " ", "  ", "\n", "\r\n", "\t", "　", " ", "\u0085", "\x1c", "a", "b", "S", "s", "t", "re", "l", "1", "23", "٣", "½", "é", "ñ", "中", "\U0001f600", "-", "--", "_", "́", "<|endoftext|>"]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def words():
    return bpe.load(bpe.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def encoded(words, texts):
    raw = [t.encode() for t in texts]
    ids, offsets, before = words.encode(b"".join(raw), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))
    return [(ids[a:b].tolist(), offsets[a:b].tolist()) for a, b in zip(before, before[1:])]


def check(words, library, texts):
    for text, (ids, offsets) in zip(texts, encoded(words, texts)):
        assert ids == library.encode_ordinary(text)
        assert words.decode(np.array(ids, np.uint32)) == text.encode()
        lengths = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert offsets == [sum(lengths[:k]) for k in range(len(ids))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join), min_size=1, max_size=5))
def test_ids_of_mixed_texts(texts):
    words = bpe.load(bpe.DEFAULT_VOCABULARY)
    check(words, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={}), texts)


def test_every_code_point_has_the_librarys_class(words, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 65_536):
        check_text = "a".join(points[at : at + 65_536 : 7]) + " ".join(points[at + 3 : at + 65_536 : 11])
        assert encoded(words, [check_text])[0][0] == library.encode_ordinary(check_text)


def test_scan_agrees_with_a_walk_and_is_associative():
    scan = bpe.scanner()
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, bpe.KINDS, 40_000).astype(np.int32)
    first = rng.random(len(kinds)) < 0.01
    first[0] = True
    state, want = bpe.S_NONE, []
    for kind, new in zip(kinds.tolist(), first.tolist()):
        state, starts = bpe._step(kind, bpe.S_NONE if new else state)
        want.append(starts)
    assert scan.boundaries(kinds, first).tolist() == want
    f, g, h = rng.integers(0, scan.size, (3, 500)).astype(np.int32)
    assert (scan._compose(scan._compose(f, g), h) == scan._compose(f, scan._compose(g, h))).all()


def test_long_runs(words, library):
    runs = ["a" + "\n" * 100_000 + "b", "ab" * 20_000, "-" * 50_000, "é" * 9_000, " " * 70_000]
    check(words, library, [r for r in runs[:1]])
    for text in runs:
        assert encoded(words, [text])[0][0] == library.encode_ordinary(text)
    for text in ("a" + "\n" * 1_000_000 + "b", " " * 1_000_000 + "a"):  # where the library's own pattern overflows
        (ids, _), = encoded(words, [text])
        assert words.decode(np.array(ids, np.uint32)) == text.encode()
        half = text[:200] + text[-2:]
        assert ids[:50] == library.encode_ordinary(half)[:50] and ids[-1] == library.encode_ordinary(half)[-1]


def test_short_and_long_merges_agree(words):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("etaoinshrñé ") for _ in range(rng.randrange(2, bpe.SHORT // 2))).encode() for _ in range(500)]
    assert words._merge_short(pieces) == [words._merge_long(p) for p in pieces]


def test_cache_may_be_forgotten_at_any_batch(words, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_SLICES", 3)
    for text in ("one two three four five", "six seven five one", "one"):
        assert encoded(words, [text])[0][0] == library.encode_ordinary(text)


def test_rows(spark, library):
    texts = [(1, "It's  a\ntest "), (1, "It's  a\ntest "), (2, ""), (3, None), (None, "x"), (4, "ñ" * 5)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in texts], SCHEMA + ", token_ids string, decoded int")
    got = sorted(map(tuple, bpe.encoding_report(docs).collect()), key=str)
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encoding_report(docs.limit(0)).count() == 0


def test_bytes_that_are_not_utf8_are_replaced(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "CAST(X'61FF62' AS STRING) AS text")
    assert bpe.decode(bpe.encode(docs)).first()["decoded"].decode() == "a�b"


def test_offsets_lead_back_to_the_text(spark, library):
    text = "The quick brown fox isn't here"
    held = bpe.encode(spark.createDataFrame([(1, text), (2, ""), (3, None)], SCHEMA))
    found = sorted((r["offset"], r["token"]) for r in bpe.tokens_between(held, 4, 15).collect())
    numbers = [0, 225, 0x8182C3E1, 0xFFFFFFFF, 65_536]
    raw = spark.createDataFrame([(np.array(numbers, "<u4").tobytes(),)], "b binary")
    assert list(raw.select(*[bpe.unsigned_at("b", F.lit(i)).alias(f"n{i}") for i in range(5)]).first()) == numbers
    ids = library.encode_ordinary(text)
    ends = np.cumsum([len(library.decode_single_token_bytes(i)) for i in ids])
    assert found == [(int(e - len(library.decode_single_token_bytes(i))), i) for i, e in zip(ids, ends) if 4 <= e - len(library.decode_single_token_bytes(i)) < 15]


def test_ids_outside_the_vocabulary_raise(words):
    with pytest.raises(ValueError):
        words.decode(np.array([words.size], np.uint32))


def test_query_against_the_library(spark, sf_dir, library):
    from corpusloom.llm import queries

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (len(ids := library.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows}
    assert {r[0]: tuple(r)[1:] for r in queries()["op13_bpe"](spark, sf_dir).collect()} == want
