import base64
import glob
import zlib

import numpy as np
import pytest

from corpusloom.llm import training_order as T

pytest.importorskip("tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    f = T.Feistel(n)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f.index(slots).tolist() == list(range(n))
    if n == 1000:
        assert T.Feistel(n, key=1).slot(np.arange(n)).tolist() != slots.tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


ROWS = [(1, "Hello world, hello."), (2, None), (3, ""), (4, "x" * 5000 + " end"), (5, "é🙂 <|endoftext|>"), (5, "é🙂 <|endoftext|>"), (None, "no id"), (6, "word " * 30_000)]


def write(spark, tmp_path, rows, **options):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([r + (1, 2) for r in rows], "doc_id long, text string, slot int, row int").repartition(3).write.parquet(source)
    T.write_training_order(spark, source, path, **({"seq_len": 16, "width": 400} | options))
    return path


def test_round_trip(spark, tmp_path):
    path = write(spark, tmp_path, ROWS)
    words = T.load_vocabulary(T.DEFAULT_VOCABULARY)
    end, want = words.end, []
    for doc, text in ROWS:
        ids = words.encoding.encode_ordinary(text) + [end] if text else []
        want += [(doc, p, tuple(ids[p * 16 : p * 16 + 16])) for p in range(-(-len(ids) // 16))]
    kind = T.record_dtype(16, "<u2")
    got, slots = [], []
    back = T.read_training_order(spark, path).collect()
    by_slot = {r["slot"]: r for r in back}
    told = spark.read.parquet(f"{path}/_manifest").first()
    assert (told["n_slots"], told["width"], told["seq_len"], told["stride"], told["vocabulary_size"]) == (len(want), 400, 16, kind.itemsize, end + 1)
    numbers = T.Feistel(told["n_slots"], told["key"], told["rounds"]).index(np.arange(told["n_slots"]))
    by_number = {}
    for shard in range(-(-len(want) // 400)):
        (name,) = glob.glob(f"{tmp_path}/out/shard={shard}/part-*")
        data = open(name, "rb").read()
        assert len(data) == kind.itemsize * min(400, len(want) - 400 * shard)  # all shards but the last are full
        for k, r in enumerate(np.frombuffer(data, kind)):
            slots.append(400 * shard + k)
            assert T.locate(slots[-1], 400, kind.itemsize) == (shard, k * kind.itemsize)
            row = by_slot[slots[-1]]
            doc = None if r["flag"] else int(r["doc_id"])
            got.append((doc, int(r["piece"]), tuple(r["tokens"][: r["n_tokens"]].tolist())))
            by_number[int(numbers[slots[-1]])] = got[-1][:2]
            assert (r["tokens"][r["n_tokens"] :] == end).all()
            assert (row["doc_id"], row["piece"], row["n_tokens"], row["shard"], row["byte_offset"]) == (doc, r["piece"], r["n_tokens"], shard, k * kind.itemsize)
            assert row["tokens_crc32"] == zlib.crc32(r["tokens"].tobytes())
        assert T.read_slots(data, 1, 2, seq_len=16).tobytes() == data[kind.itemsize : 3 * kind.itemsize]
    # the slot is the permuted number: in the order of the numbers, a document's pieces follow each other
    follows = [by_number[i] for i in range(len(want))]
    assert all(b[1] == 0 or (a[0], a[1] + 1) == b for a, b in zip(follows, follows[1:]))
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == len(back) and slots == list(range(len(want)))
    assert got != sorted(got, key=str)


def test_empty(spark, tmp_path):
    path = write(spark, tmp_path, [(1, None), (2, "")])
    assert T.read_training_order(spark, path).count() == 0


def test_long_records_and_large_vocabularies(spark, tmp_path):
    ranks = tmp_path / "wide.tiktoken"
    with open(T.DEFAULT_VOCABULARY, "rb") as f:
        held = f.read()
    more = b"".join(base64.b64encode(f"\x00filler {i}".encode()) + f" {i}\n".encode() for i in range(50_256, 70_000))
    ranks.write_bytes(held.rstrip(b"\n") + b"\n" + more)
    rows = [(1, "word " * 200_000), (2, "x")]
    path = write(spark, tmp_path, rows, seq_len=70_000, width=2, vocabulary=str(ranks), waves=1)
    told = spark.read.parquet(f"{path}/_manifest").first()
    assert told["vocabulary_size"] > 1 << 16 and T.id_type_of(told["vocabulary_size"]) == "<u4"
    back = {(r["doc_id"], r["piece"]): r["n_tokens"] for r in T.read_training_order(spark, path).collect()}
    words = T.load_vocabulary(str(ranks))
    for doc, text in rows:
        n = len(words.encoding.encode_ordinary(text)) + 1
        assert [back[doc, p] for p in range(-(-n // 70_000))] == [min(70_000, n - p * 70_000) for p in range(-(-n // 70_000))]


def test_ids_must_be_whole_numbers(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "doc_id string, text string").write.parquet(f"file://{tmp_path}/in")
    with pytest.raises(TypeError, match="whole numbers"):
        T.write_training_order(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")


def test_whole_table(spark, sf_dir):
    found = T.training_order(spark, f"{sf_dir}/documents.parquet")
    slots = [r[0] for r in found.select("slot").collect()]
    assert sorted(slots) == list(range(len(slots)))
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").count()


@pytest.mark.parametrize("text", ["a" + "\n" * 5_000_000 + "b", " " * 1_000_000 + "a", " " * 3_000_000, "x" * 200_000, "-" * 200_000, "é " * 100_000])
def test_long_runs_are_encoded_whole(text):
    words = T.load_vocabulary(T.DEFAULT_VOCABULARY)
    assert b"".join(words.encoding.decode_tokens_bytes(words.encode(text).tolist())).decode() == text


def test_the_two_tokenisers_agree_on_runs(monkeypatch):
    words = T.load_vocabulary(T.DEFAULT_VOCABULARY)
    texts = ["a" + c * n + end for c in " \n\t\u3000" for n in (1, 2, 3, 700, 20_000) for end in ("", "b", "\n")]
    plain = [words.encode(t).tolist() for t in texts]
    monkeypatch.setattr(T, "LONG_RUN", 0)
    monkeypatch.setattr(T, "_RUN", T.re.compile(r"\s"))
    assert [words.encode(t).tolist() for t in texts] == plain
