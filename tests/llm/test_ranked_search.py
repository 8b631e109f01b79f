"""Ranked results against a scan of all pairs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ranked_search as search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [] if text is None else TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(docs, items, best=10):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    if not held:
        return []
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in held:
            m = 10 + (90 * sum(counts.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) if t in counts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **how):
    found = search.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how)
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    pick = lambda k: " ".join(f"w{min(int(rng.expovariate(0.08)), words)}" for _ in range(k))
    return [(i, pick(rng.choice([1, 5, 20, 120]))) for i in range(n)], [(i, pick(rng.choice([1, 4, 15]))) for i in range(40)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # many chunks, leaves and blocks, two waves, halves, shuffled joins
        for name, value in (("CHUNK", 40), ("LEAF", 4), ("GROUP", 3), ("BLOCK", 16), ("NODE", 4), ("FIRST_CHUNKS", 1), ("MOST_CELLS", 20), ("BROADCAST_TERMS", 0), ("BROADCAST_PAIRS", 0), ("BROADCAST_ITEMS", 0)):
            monkeypatch.setattr(search, name, value)
    docs, items = corpus(1, 400)
    assert ranked(spark, docs, items) == brute(docs, items)


def test_ties_repeats_nulls_and_characters(spark):
    docs = [(3, "Alpha beta"), (3, "Alpha beta"), (1, "alpha BETA"), (None, "alpha beta"), (9, None), (8, ""), (7, "?!"), (2, "Ñandú gamma"), (5, "delta " * 30_000)]
    items = [(1, "beta"), (1, "beta"), (2, None), (3, ""), (4, "Ñandú"), (5, "ñandú"), (6, "delta, absent"), (None, "gamma-alpha")]
    assert ranked(spark, docs, items) == brute(docs, items)
    many = [(i, "same words here") for i in range(50)]
    assert [r[2] for r in sorted(ranked(spark, many, [(1, "words")]), key=lambda r: r[1])] == list(range(10))


def test_empty_sides_and_extra_columns(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None)], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], DOCS)
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "id", "n", "terms", "block", "score")])
    items = spark.createDataFrame([(1, "b")], ITEMS).withColumn("rank", F.lit("x"))
    assert sorted(map(tuple, search.rank_documents(more, items).collect())) == brute([(1, "a b"), (2, "b")], [(1, "b")])
    with pytest.raises(TypeError):
        search.rank_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"), items)


def test_a_full_bitmap_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(search, "SLOTS", 2)
    docs, items = corpus(4, 60)
    assert ranked(spark, docs, items) == brute(docs, items)


def test_bounds_leave_pairs_out(monkeypatch):
    """A leaf whose bound is below every floor is not scored."""
    import numpy as np
    import pyarrow as pa

    n = search.LEAF * search.GROUP
    documents = pa.table({"place": list(range(2 * n)), "id": list(range(2 * n)), "terms": [["rare"]] * n + [["common"]] * n, "impacts": [[900]] * n + [[5]] * n})
    items = pa.table({"irow": [1], "item_id": [7], "terms": [["rare", "common"]], "weights": [[50, 1]], "floor": [0]})
    seen = []
    whole = np.add.reduceat
    monkeypatch.setattr(search.np, "add", type("Counting", (), {"reduceat": staticmethod(lambda a, at, axis: seen.append(a.shape[1]) or whole(a, at, axis=axis))}))
    found = pa.Table.from_batches(search._search(documents, items, 10))
    assert found.column("doc_id").to_pylist() == list(range(10)) and sum(seen) <= n
