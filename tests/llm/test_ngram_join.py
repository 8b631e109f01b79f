import random
import re

import numpy as np
import pytest

from corpusloom.llm import ngram_join as N
from corpusloom.llm.components import connected_components


def sets_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(docs):
    own = [(d, sets_of(t)) for d, t in docs]
    label = {d: d for d, _ in own if d is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(own):
        for b, t in own[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return sorted((str(d), len(s), root(d) if d is not None else None) for d, s in own)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = [rng.choice(words) for _ in range(60)]
    docs, i = [], 1000
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 150]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((i, rng.choice([" ", "\n", "  "]).join(copy)))
            i += rng.choice([1, -3, 7])
    return list({d: (d, t) for d, t in docs}.values())


def got(spark, docs):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, digest string, n int")
    return sorted((str(r[0]), r[1], r[2]) for r in N.ngram_components(frame).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    assert got(spark, docs) == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "É b"), (8, "é b"), (9, "x " * 100_000), (3, "a b"), (10, "p q r s t u"), (10, "p q r s t u"), (10, "k l"), (11, "k l")]
    assert got(spark, docs + [(None, "solo words here"), (None, None)]) == sorted([
        ("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("3", 1, 3), ("4", 1, 3), ("5", 1, 3), ("6", 1, 6), ("7", 1, 7), ("8", 1, 8), ("9", 1, 9),
        ("10", 2, 10), ("10", 2, 10), ("10", 1, 10), ("11", 1, 10), ("None", 1, None), ("None", 0, None),
    ])


def test_empty(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_bands_and_blocks_give_the_same(spark, monkeypatch):
    docs = corpus(3, 12)
    monkeypatch.setattr(N, "BAND_WEIGHT", 3000)
    monkeypatch.setattr(N, "KEY_BLOCK", 4)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    assert got(spark, docs) == brute(docs)


def test_keep_one_of_each(spark):
    docs = corpus(4, 10)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, digest string, n int")
    kept = N.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r[0] for r in kept.collect()) == sorted({r[2] for r in brute(docs)})
    again = N.keep_one_of_each(frame.unionByName(frame.limit(5)))
    assert sorted(r[0] for r in again.collect()) == sorted({r[2] for r in brute(docs)})


def test_hashes_follow_the_words():
    texts = ["a b c d e", "A\tb\n c d  e ", "", "ab c d e", "a b c d e f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    sets = [frozenset(s.tolist()) for s in N.shingle_sets(data, offsets)]
    assert sets[0] == sets[1] and len(sets[2]) == 0 and len(sets[4]) == 2 and sets[0] < sets[4]
    assert sets[3] != sets[0]


def test_pieces_do_not_change_hashes(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(50)] + ["x" * 9000, "y z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    want = [s.tolist() for s in N.shingle_sets(data, offsets)]
    for size in (1, 7, 100):
        monkeypatch.setattr(N, "PIECE", size)
        assert [s.tolist() for s in N.shingle_sets(data, offsets)] == want


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 80), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: max(1, int(len(a) * 0.9))], rng.integers(0, 1 << 60, len(a) // 10, dtype=np.uint64))))
        frequent = np.sort(rng.permutation(a)[: len(a) // 2])
        if N.linked(a, b):
            assert set(N.prefix_of(a, frequent).tolist()) & set(N.prefix_of(b, frequent).tolist())
            total = len(a) + len(b)
            x, y = N.signature(a), N.signature(b)
            if len(x) > len(y):
                x, y = y, x
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            assert N.may_link(total, int(np.bitwise_count(x ^ y).sum()))


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    label = list(range(2000))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got.get(x, x) == label[x] for x in range(2000))
