import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import embedding_dedup as E


def brute(rows):
    ok, unit = [], []
    for i, (id_, v) in enumerate(rows):
        if id_ is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        ok.append(i)
        unit.append(x / np.linalg.norm(x))
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(ok)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[ok[a]] += 1
                links[ok[b]] += 1
                x, y = label[ok[a]], label[ok[b]]
                label = [x if k == y else k for k in label]
    out = []
    for i, (id_, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        low = min(own) if id_ is not None else None
        out.append((id_, links[i], low, None if id_ is None else low == id_))
    return sorted(out, key=str)


def corpus(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        rows.append((int(i * 3 % 1009), (c / np.linalg.norm(c) + rng.normal(size=dim) * spread / np.sqrt(dim)).tolist()))
    return rows


def got(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "b", 1) for i, v in rows], "vec_id long, embedding array<double>, digest string, weight int")
    return sorted((tuple(r) for r in E.near_duplicates(frame, **options).collect()), key=str)


@pytest.mark.parametrize("dim,spread", [(64, 0.15), (20, 0.2)])
def test_against_brute_force(spark, dim, spread):
    rows = corpus(1, 300, dim, spread)
    rows += [(2000 + i, rows[0][1]) for i in range(15)]
    assert got(spark, rows) == brute(rows)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))]
    found = sum(r[1] for r in got(spark, rows))
    assert found >= 0.98 * sum(r[1] for r in brute(rows))


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_stated_misses(dim):
    n, (missed, of) = 1000, E.MISSES[dim]
    rng = np.random.default_rng(11)
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.9**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    apart = E._first_common(E.bucket_codes(a, *E.PLAN), E.bucket_codes(b, *E.PLAN)) == np.iinfo(np.int64).max
    assert abs(apart.mean() - missed / of) <= 0.01
    differ = np.bitwise_count(E.sketches(a) ^ E.sketches(b)).sum(axis=1)
    assert differ.max() <= E.APART - 25
    far = np.bitwise_count(E.sketches(a) ^ E.sketches(a[::-1])).sum(axis=1)
    assert (far <= E.APART).mean() <= 0.01


@pytest.mark.parametrize("size", [1, 7, 500])
def test_near_members(size):
    rng = np.random.default_rng(3)
    centres = E.sketches(rng.normal(size=(12, 16)))
    rows = []
    for tile in range(60):
        low, high = (0, 0) if tile % 2 else (1, 3)
        for i in range(int(rng.integers(1, 60))):
            rows.append((tile // 3, low, high, low if rng.random() < 0.5 else high, 1000 * tile + i, centres[rng.integers(12)].tobytes()))
    rows.sort(key=lambda r: r[:3])
    want = set()
    for r in rows:
        for q in rows:
            apart = sum(int(x).bit_count() for x in np.frombuffer(r[5], np.uint64) ^ np.frombuffer(q[5], np.uint64))
            if r[:3] == q[:3] and r[4] != q[4] and apart <= E.APART and (r[1] == r[2] or r[3] != q[3]):
                want.add(r[:5])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = ["bucket", "low", "high", "side", "cid", "sketch"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], names=names) for i in range(0, len(rows), size)]
    assert {tuple(r.values()) for b in E._near(iter(batches)) for r in b.to_pylist()} == want and len(want) > 100


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 8])
def test_few_dimensions(spark, dim):
    rows = corpus(7, 120, dim, 0.3)
    want, have = brute(rows), got(spark, rows)
    assert sum(r[1] for r in have) >= 0.98 * sum(r[1] for r in want) and all(h[1] <= w[1] for h, w in zip(have, want))


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        E.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_blocks(spark):
    rows = corpus(2, 200, 32, 0.1)
    assert got(spark, rows, block=7) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [1e300, 1e300]), (13, [1e-300, 1e-300])]
    assert got(spark, rows) == brute([(i, v) if i not in (12, 13) else (i, [1.0, 1.0]) for i, v in rows])
    assert got(spark, []) == []
