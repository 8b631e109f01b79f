import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import language as L


def test_codewords_are_far_apart():
    for k in range(2, 14):
        code = L.codewords(k)
        least = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert len(code) == k and least >= max(1, code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < k).all()


def test_one_wrong_bit_is_corrected():
    model = L.Model(["a", "b", "c", "d"])
    for k in range(4):
        for bit in range(model.code.shape[1]):
            odds = model.code[k].astype(float)
            odds[bit] *= -1
            assert model.losses(odds[None])[0].argmin() == k


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = L.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and len(held) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows_are_never_learned_from(spark):
    rows = [(i, "aba " * 20 if i % 2 else "xyx " * 20, "a" if i % 2 else "x", "s") for i in range(200)]
    rows = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    found = L.identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["lang_pred"] for r in found} == {"a", "x"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_edges(spark):
    rows = [(i, "the and of to in " * 5, "en") for i in range(30)] + [(30 + i, "der die das und nicht " * 5, "de") for i in range(30)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !?", None), (103, "é", None), (104, "the of " * 200_000, None), (None, "und das", None), (105, "das", None), (105, "das", None)]
    frame = spark.createDataFrame([r + (1.0,) for r in rows], "doc_id long, text string, lang string, score double")
    found = L.identify_held_out(frame).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for und in (100, 101, 102):
        assert by[und]["lang_pred"] == "und" and by[und]["score"] == 0
    assert by[103]["lang_pred"] in ("en", "de") and by[104]["lang_pred"] == "en" and by[105]["lang_pred"] == "de"
    kept = L.keep_identified(frame, L.train(frame))
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} >= {104, 105, None, *range(60)}
    assert not {r["doc_id"] for r in kept.collect()} & {100, 101, 102}


def test_without_labels_and_with_one_language(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:4] for r in L.identify_held_out(none).collect()] == [("und", 0.0)]
    assert L.identify_held_out(none.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abc", "en"), (2, "zzz", None), (3, "7", None)], "doc_id long, text string, lang string")
    assert sorted(r["lang_pred"] for r in L.identify_held_out(one).collect()) == ["en", "en", "und"]


def test_long_texts_are_read_whole():
    model = L.Model(["a", "b"])
    text = np.frombuffer(b"x" * 300_000, np.uint8)
    grams = sum(len(b) for b in L.ngram_buckets(text))
    assert grams >= len(L.ORDERS) * len(text)
    assert model.predict(pa.array(["x" * 300_000]))[0] == ["a"]


def test_the_stage_rejects_by_its_decoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.train(docs, where=~L.is_held_out())
    other = ["η γάτα και ο σκύλος είναι στο σπίτι και τρώνε το φαγητό τους ", "妺簖妓淋蘿軩篩羞春钞崣訌啌罘抗斕橀踮軅抚囌 ", "кошка и собака дома и едят свою еду каждый вечер "]
    added = spark.createDataFrame([(10_000_000 + i, t * 5, None) for i, t in enumerate(other)] + [(10_000_009, "12 !?", None), (10_000_010, None, None)], "doc_id long, text string, lang string")
    given = docs.unionByName(added, allowMissingColumns=True)
    kept = {r["doc_id"]: r["lang"] for r in L.keep_identified(given, model).collect()}
    assert not any(i >= 10_000_000 for i in kept)
    readable = [r for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    assert set(kept) == {r["doc_id"] for r in readable}  # clean documents stay, held out or not
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    filled = {r["doc_id"]: r["lang"] for r in L.keep_identified(unlabelled, model).collect()}
    assert np.mean([filled[r["doc_id"]] == r["lang"] for r in readable]) > 0.95


def slow_buckets(text):
    """The hashed 2- to 4-grams of a text, one at a time."""
    folded = [32] + [c if c > 127 or 97 <= c <= 122 else 32 for c in text.lower().encode()] + [32] * 3
    for at in range(len(folded) - 3):
        for order in (2, 3, 4):
            gram = int.from_bytes(bytes(folded[at : at + order]), "big")
            yield ((gram + order * 0x1F123BB5) % 2**32 * 2654435761 % 2**32) >> (32 - L.BITS)


def slow_decoder(labelled):
    """An independent learner and decoder; gives a function from a text to (losses by language, languages)."""
    languages = sorted({lang for _, lang in labelled})
    counts = {k: Counter() for k in languages}
    for text, lang in labelled:
        counts[lang].update(slow_buckets(text))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    scale = {k: sum(totals.values()) / len(totals) / totals[k] for k in languages}
    mass = sum(totals.values()) / len(totals) + L.SMOOTHING * 2**L.BITS
    code = {k: word.tolist() for k, word in zip(languages, L.codewords(len(languages)))}
    bits = range(len(code[languages[0]]))
    known = {}

    def weight(b, j):
        if (b, j) not in known:
            p = {k: (counts[k][b] * scale[k] + L.SMOOTHING) / mass for k in languages}
            up, down = [p[k] for k in languages if code[k][j] > 0], [p[k] for k in languages if code[k][j] < 0]
            known[b, j] = math.log(sum(up) / len(up) / (sum(down) / len(down)))
        return known[b, j]

    def odds(text):
        grams = Counter(slow_buckets(text))
        return [sum(n * weight(b, j) for b, n in grams.items()) / sum(grams.values()) for j in bits]

    trust = {}
    for k in languages:
        own = [odds(text) for text, lang in labelled if lang == k]
        trust[k] = [(sum((o[j] > 0) == (code[k][j] > 0) for o in own) + 1) / (len(own) + 2) for j in bits]

    def losses(text):
        o = odds(text)
        return {k: sum(trust[k][j] * math.log1p(math.exp(-o[j] * code[k][j] * L.SLOPE)) for j in bits) / sum(trust[k]) for k in languages}

    return losses


def test_against_an_independent_decoder(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    losses = slow_decoder([(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None and not held_out(r["doc_id"])])
    found = {r["doc_id"]: r for r in L.identify_held_out(docs, sample_per_language=1_000_000).collect()}
    for r in rows:
        own = found[r["doc_id"]]
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        loss = losses(r["text"])
        best = min(sorted(loss), key=loss.get)
        n = len(L.codewords(len(loss))[0])
        like = {k: math.exp(-(v - loss[best]) * n) for k, v in loss.items()}
        assert own["lang_pred"] == best and abs(own["score"] - like[best] / sum(like.values())) < 1e-4


def test_the_sample_is_bounded(spark):
    rows = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the cat and the dog").alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise(F.concat(F.lit("x"), F.col("id") % 500)).alias("lang"))
    model = L.train(rows, sample_per_language=100, most_languages=5)
    assert "en" in model.languages and len(model.languages) == 5


def test_every_label_is_learned(spark):
    """More labels than any fixed number: each has a word of its own."""
    rows = spark.range(300 * 4).select("id", (F.col("id") % 300).alias("k")).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("qz"), F.conv("k", 10, 26)), F.substring(F.sha2(F.col("k").cast("string"), 256), 1, 24)).alias("text"), F.concat(F.lit("l"), "k").alias("lang"))
    model = L.train(rows)
    assert len(model.languages) == 300
    found = L.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 0.95 * 1200
