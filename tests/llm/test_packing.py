import itertools
import random
import re
from collections import Counter, defaultdict

from corpusloom.llm import packing as P


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= k) - k) for k, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        histogram = {rng.randrange(1, 40): rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))}
        for k in range(1, 6):
            found = P.optimal_boundaries(histogram, k)
            top = max(histogram)
            best = min(padding(histogram, [*c, top]) for r in range(min(k, len(histogram))) for c in itertools.combinations(sorted(histogram), r))
            assert len(found) <= k and padding(histogram, found) == best
    assert P.optimal_boundaries({}, 4) == []


def check(rows, docs, max_len, budget):
    words = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in docs]
    want = sorted(str((d, p, min(n - p * max_len, max_len))) for d, n in words for p in range(max(1, -(-n // max_len))))
    assert sorted(str((r["doc_id"], r["piece"], r["n_tokens"])) for r in rows) == want
    batches = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["bucket_len"]
            batches[r["bucket"], r["batch_id"]].append(r)
        else:
            assert r["bucket"] is None and r["batch_id"] is None
    for (bucket, batch), own in batches.items():
        room = max(1, budget // own[0]["bucket_len"])
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) <= room
        if (bucket, batch + 1) in batches:
            assert len(own) == room
    for bucket in {b for b, _ in batches}:
        assert sorted(b for k, b in batches if k == bucket) == list(range(sum(k == bucket for k, _ in batches)))


def test_pack(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 7, 20, 64, 65, 200]))) for i in range(500)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (903, "a b"), (None, "a b c"), (904, "x " * 50_000)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, bucket int, slot int")
    rows = P.pack(frame, max_len=64, buckets=4, token_budget=256, shards=8).collect()
    check(rows, docs, 64, 256)


def test_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 7)
    docs = [(None, "a b c")] * 60 + [(5, "a b")] * 40 + [(5, "a")] * 3 + [(6, "w " * 130)] * 9
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(P.pack(frame, max_len=64, buckets=3, token_budget=256, shards=4).collect(), docs, 64, 256)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(P.pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], P.MAX_LEN, P.TOKEN_BUDGET)


def test_token_ids_in_padded_batches(spark):
    import numpy as np

    from corpusloom.llm import bpe

    texts = [(1, "one two three four five six seven"), (1, "other text of the same id"), (2, ""), (3, None), (None, "isn't it"), (4, "ñandú " * 30), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, bucket string")
    words = bpe.load(bpe.DEFAULT_VOCABULARY)
    encode = lambda t: words.encode((t or "").encode(), np.array([0, len((t or "").encode())]))[:2]
    packed = P.pack_tokens(docs, max_len=16, buckets=3, token_budget=32)
    rows = packed.collect()
    want = []
    for i, t in texts:
        ids, offsets = encode(t)
        for piece in range(max(1, -(-len(ids) // 16))):
            part = slice(piece * 16, piece * 16 + 16)
            want.append((i, piece, int(offsets[piece * 16]) if len(ids) else 0, tuple(ids[part].tolist())))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["first_byte"], tuple(np.frombuffer(r["token_ids"] or b"", "<u4").tolist()))) for r in rows)
    histogram = Counter(r["n_tokens"] for r in rows if r["n_tokens"])
    ends = P.optimal_boundaries(histogram, 3)
    batches = P.padded_batches(packed, 50_256).collect()
    seen = []
    for b in batches:
        matrix = np.frombuffer(b["tokens"], "<u4").reshape(len(b["sequences"]), b["bucket_len"])
        assert b["bucket_len"] in ends and matrix.size <= max(32, b["bucket_len"])
        for s, line in zip(b["sequences"], matrix):
            assert (line[s["n_tokens"] :] == 50_256).all() and not (line[: s["n_tokens"]] == 50_256).any()
            seen.append((s["doc_id"], s["piece"], tuple(line[: s["n_tokens"]].tolist())))
    assert sorted(map(str, seen)) == sorted(str((w[0], w[1], w[3])) for w in want if w[3])
    assert P.padded_batches(P.pack_tokens(docs.limit(0)), 0).count() == 0
