import hashlib
import random
import re

import pytest

from corpusloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, window=10):
    strings = {}
    for item, text in items:
        if text is None:
            continue
        w = WORD.findall(low(text))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            strings.setdefault(tuple(w[i : i + m]), set()).update([] if item is None else [item])  # without an id, it hits and is not listed
    out = []
    for doc, text in docs:
        w = WORD.findall(low(text)) if text is not None else []
        hit, found = set(), set()
        for s, owners in strings.items():
            for i in range(len(w) - len(s) + 1):
                if tuple(w[i : i + len(s)]) == s:
                    hit.update(range(i, i + len(s)))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    words = ["Ab", "b", "cd", "É", "ß9", "x1", "the"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(12, None), (13, ""), (14, "?!"), (None, "ab"), (3, text(12))]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(60 + i, text(20) + " " + t + "." + text(5)) for i, (_, t) in enumerate(items[:12])]
    docs += [(80, None), (81, ""), (82, " . "), (83, text(20000)), (5, text(9)), (5, text(9)), (None, text(30))]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, block_bytes):
    docs, items = cases()
    frame = spark.createDataFrame([(d, t, 7, "y") for d, t in docs], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, spans double")
    got = [tuple(r) for r in D.contamination_report(frame, bench, block_bytes=block_bytes).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_short_strings_do_not_hide_long_ones(spark):
    docs = [(1, "a b c d e f g h i j k l"), (2, "c"), (3, "q")]
    items = [(1, "c"), (2, "a b c d e f g h i j"), (3, "d e f g h i j k l m")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in D.contamination_report(frame, bench).collect()) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_report(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination_report(one, bench).collect()] == [(1, 2, 0, 0)]


def test_drop_contaminated_keeps_columns_and_clean_rows(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(d, t, 7, "y") for d, t in docs], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    want = sorted(str(r[0]) for r in brute(docs, items) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_an_item_without_id_hits_but_is_not_listed(spark):
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 tail"), (2, "none of these")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    found = {r["doc_id"]: r for r in D.contamination_report(docs, items).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"], found[1]["contaminated"]) == (10, 0, True) and not found[2]["contaminated"]
    assert [r["doc_id"] for r in D.drop_contaminated(docs, items).collect()] == [2]


def test_ids_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        D.find_contamination(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))
