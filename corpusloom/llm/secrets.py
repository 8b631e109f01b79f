"""Secret scans with Spark expressions only.

Base patterns find assigned secrets, access keys and hexadecimal strings.
Beside them every long run of token characters is scored by two character
Markov models, one of random strings and one of ordinary identifiers: the mean
log-likelihood ratio of its character pairs decides.  Both models are trained
from labelled samples, as pair counts that Spark aggregates; the sample's size
is a documented bound.  A quarter of the sample, by a hash of its text, is held
out: the threshold is the QUANTILE of the held-out ordinary scores.  Spans are
code-point offsets, end exclusive.

Work is linear in a text's length: a kind's matches are marked by one
replacement and cut apart by one split, offsets are prefix sums over the pieces,
and a run is scored as a string of its own.  Texts are cut by pieces of PIECE
characters, so that no cut walks the text from its start.

Defined results: a null text is empty and has no spans; matches of one kind are
leftmost and do not overlap; matches that fail their length are dropped but
still consume text; a Markov span that meets a base span is dropped; repeated
rows each give a row; extra columns are not read by the scan.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release

KEYWORD = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
VALUE = r"[A-Za-z0-9+/_.=-]"
#: kind, pattern of a match as (before its value)(value), a pattern that any text with a span of the kind meets, least
#: length of the value.  Runs of hexadecimal digits and access keys are maximal, so their length is in the pattern; an
#: assignment that is too short still consumes text, so it is matched and then dropped.
BASE = (
    ("assign", f"{KEYWORD}({VALUE}+)", f"{KEYWORD}{VALUE}{{12,}}", 12),
    ("access", r"()(AKIA[A-Z0-9]{14,})", r"AKIA[A-Z0-9]{14,}", 18),
    ("hex", r"()([0-9a-f]{16,})", r"[0-9a-f]{16,}", 16),
)
#: What a text with an assignment has, of each group one, in lower case.
ASSIGN_SIGNS = ((":", "="), ("password", "passwd", "secret", "token", "apikey", "api_key"))
MARKOV = "markov"
#: Characters of a run that the models score, at least.
RUN = 20
_TOKEN_CHAR = "[A-Za-z0-9+/_=-]"
TOKEN = f"{_TOKEN_CHAR}{{{RUN},}}"
#: Access keys, hexadecimal strings and scored runs all lie in such a run, tried only where one starts.
LONG = f"(?<!{_TOKEN_CHAR}){_TOKEN_CHAR}{{{min(RUN, *(least for _, _, _, least in BASE[1:]))},}}"
#: Labelled strings of each class that the models learn from and are tested on.
SAMPLE = 4000
#: Documents, about, that labelled strings are taken from, and what counts as an ordinary string there.
SAMPLE_DOCS, ORDINARY = 4000, r"(?<![A-Za-z0-9+/_=-])[A-Za-z/_-]{10,}(?![A-Za-z0-9+/_=-])"
#: Share of held-out ordinary strings that score below the threshold.
QUANTILE = 0.999
#: Least threshold, a mean log-likelihood ratio of a character pair: where both models are even.
LEAST = 0.0
#: Elements of a block of prefix sums, and characters of a piece that texts are cut by.
BLOCK, PIECE = 128, 1024
_WIDTH = 128
_WORDS = (
    "get set user name index count value list map key data file path read write open close server client request response "
    "config option parse format build test main node edge graph table column row query join filter sort page page view model "
    "token text line word char byte buffer stream event time date start stop update delete insert create find search match "
    "image color width height size length number string object array class method function return error status result "
    "the of and to in is that for with are this from have not was which one all their has will more about other"
).split()


def generated_samples(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """Rows (random boolean, text): n random strings and n identifiers of common words, the same on every run."""
    words = F.array(*[F.lit(w) for w in _WORDS])
    word = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(_WORDS))) + 1).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(6))
    parts = F.array(*[word(i) for i in range(5)])
    camel = F.transform(parts, lambda w, i: F.when(i > 0, F.initcap(w)).otherwise(w))
    digits = F.pmod(F.xxhash64("id", F.lit("digits")), F.lit(2100)).cast("string")
    plain = (
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, F.array_join(parts, "-"))
        .when(style == 2, F.array_join(parts, "/"))
        .when(style == 3, F.array_join(camel, ""))
        .when(style == 4, F.upper(F.array_join(parts, "_")))
        .otherwise(F.concat(F.array_join(parts, ""), digits))
    )
    rows = spark.range(n)
    seeded = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    strange = F.when(F.col("id") % 4 == 0, F.substring(seeded, 1, 40)).otherwise(F.regexp_replace(F.base64(F.unhex(seeded)), "=+$", ""))
    return rows.select(F.lit(True).alias("random"), strange.alias("text")).unionByName(rows.select(F.lit(False).alias("random"), plain.alias("text")))


def _may_hold(text, kind: str, long):
    """Cheap condition that every text with a span of the kind meets; long: whether the text has a long run."""
    if kind != "assign":
        return long
    lower = F.lower(text)
    groups = [[F.contains(lower, F.lit(sign)) for sign in signs] for signs in ASSIGN_SIGNS]
    return reduce(and_, [reduce(or_, group) for group in groups])


def document_samples(documents: DataFrame, *, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows (random boolean, text), distinct, from about sample_docs texts: the values of base matches, and words without a digit that are no such value."""
    share = sample_docs / max(documents.count(), 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = documents.where(F.pmod(F.xxhash64(text), F.lit(1_000_003)) < share * 1_000_003).select(text.alias("text"))
    some = some.withColumn("long", F.col("text").rlike(LONG))
    values = F.concat(
        *[
            F.when(_may_hold(F.col("text"), kind, F.col("long")), F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(2)), lambda v, least=least: F.length(v) >= least)).otherwise(F.array().cast("array<string>"))
            for kind, pattern, _, least in BASE
        ]
    )
    words = F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))
    found = some.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), values.alias("texts")), F.struct(F.lit(False).alias("random"), words.alias("texts")))).alias("x"))
    return found.select("x.random", F.explode("x.texts").alias("text")).groupBy("text").agg(F.max("random").alias("random")).select("random", "text")


def labelled_samples(spark: SparkSession, documents: DataFrame | None = None, **options) -> DataFrame:
    """What the models learn from: generated strings, and those of a bounded sample of documents where given."""
    made = generated_samples(spark)
    return made if documents is None else made.unionByName(document_samples(documents, **options))


class Model(NamedTuple):
    """Log-likelihood ratio of each pair of ASCII characters, random over ordinary (index 128 * first + second), and its test."""

    pairs: list[float]
    threshold: float
    recall: float
    precision: float


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def train(samples: DataFrame, smoothing: float = 0.5) -> Model:
    """Learns pair ratios from three quarters of the samples and the threshold from the others."""
    samples = materialize(samples.where(F.length("text") > 1), "secret-samples")
    held_out = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    codes = F.transform(F.split("text", ""), F.ascii)
    pairs = samples.where(~held_out).select("random", _let(codes, lambda c: _pairs(c)).alias("pairs")).select("random", F.explode("pairs").alias("pair"))
    counted = pairs.where(F.col("pair") < _WIDTH * _WIDTH).groupBy("pair").agg(F.count_if("random").alias("odd"), F.count_if(~F.col("random")).alias("plain"))
    odd, plain = {}, {}
    for r in counted.collect():  # 128 x 128 rows at most
        odd[r["pair"]], plain[r["pair"]] = r["odd"], r["plain"]
    alphabet = [ord(c) for c in _ALPHABET]
    table = [0.0] * (_WIDTH * _WIDTH)
    for a in alphabet:
        row = [a * _WIDTH + b for b in alphabet]
        total_odd = sum(odd.get(p, 0) for p in row) + smoothing * len(alphabet)
        total_plain = sum(plain.get(p, 0) for p in row) + smoothing * len(alphabet)
        for p in row:
            table[p] = math.log((odd.get(p, 0) + smoothing) / total_odd) - math.log((plain.get(p, 0) + smoothing) / total_plain)
    scored = samples.where(held_out).select("random", score(F.col("text"), _literal(table)).alias("score"))
    threshold = scored.where(~F.col("random")).agg(F.percentile("score", F.lit(QUANTILE))).first()[0]
    threshold = LEAST if threshold is None else max(LEAST, threshold)
    flagged = F.col("score") >= threshold
    hit, missed, wrong = scored.agg(F.count_if(F.col("random") & flagged), F.count_if(F.col("random") & ~flagged), F.count_if(~F.col("random") & flagged)).first()
    release(samples)
    return Model(table, threshold, hit / max(hit + missed, 1), hit / max(hit + wrong, 1))


def _let(value, body):
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _literal(pairs: list[float]):
    return F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in pairs) + "]"), "array<double>")


def _pairs(codes):
    """128 * code + next code of each two neighbours of an array of at least two."""
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * _WIDTH + b)


def score(text, pairs):
    """Mean log-likelihood ratio of the pairs of a string of at least two characters."""
    ratios = _let(F.transform(F.split(text, ""), F.ascii), lambda c: F.transform(_pairs(c), lambda p: F.element_at(pairs, p + 1)))
    return _let(ratios, lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / F.size(r))


def _running(values, zero, fold):
    """fold over the elements before each one of an int array, by blocks, so that no long array grows element by element."""
    zero = F.lit(zero).cast("int")
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    before = lambda block, at: F.aggregate(block, start(at), step, lambda acc: acc["out"])
    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    blocks = lambda v: F.transform(numbers(v), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    totals = lambda bs: F.transform(bs, lambda block: F.aggregate(block, zero, fold))
    done = lambda bs: F.flatten(F.zip_with(bs, _let(totals(bs), lambda t: before(t, zero)), before))
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), done)).otherwise(F.array().cast("array<int>")))


_SPAN = "struct<start:int,rank:int,stop:int,kind:string,value:string>"
_NO_SPANS = f"array<{_SPAN}>"
_MARK = "\x01"


def _spans(text, kind: str, rank: int, pattern: str, least: int):
    """Array of spans: all matches of the pattern, of which those whose value is long enough stay; text has no mark."""
    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$1{_MARK}$2{_MARK}")), _MARK, -1)
    # pieces: gap, before the value, value, gap, ...
    triples = lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p) - 3, F.lit(3)),
        lambda i: F.struct(F.length(F.get(p, i - 1)).alias("gap"), (F.length(F.get(p, i)) + F.length(F.get(p, i + 1))).alias("len"), F.get(p, i + 1).alias("value")),
    )
    offsets = lambda t: _running(F.transform(t, lambda x: x["gap"] + x["len"]), 0, lambda a, x: a + x)
    spans = lambda t, at: F.zip_with(
        t,
        at,
        lambda x, a: F.struct((a + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (a + x["gap"] + x["len"]).alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")),
    )
    found = _let(cut, lambda p: F.when(F.size(p) > 3, _let(triples(p), lambda t: F.filter(_let(offsets(t), lambda at: spans(t, at)), lambda s: F.length(s["value"]) >= least))))
    return F.coalesce(found, F.array().cast(_NO_SPANS))


def _apart(spans):
    """Of spans in order, the base spans and those that meet none of them."""
    base = lambda s: s["rank"] < len(BASE)
    reached = lambda all_: _running(F.transform(all_, lambda s: F.when(base(s), s["stop"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
    far = (1 << 31) - 1
    ahead = lambda all_: F.reverse(
        _running(F.reverse(F.transform(all_, lambda s: F.when(base(s), s["start"]).otherwise(far))), far, lambda a, x: F.least(a, x))
    )
    free = lambda s, before, after: base(s) | ((before <= s["start"]) & (after >= s["stop"]))
    mark = lambda all_, before, after: F.zip_with(
        F.zip_with(all_, before, lambda s, b: F.struct(s.alias("s"), b.alias("b"))), after, lambda x, a: F.struct(x["s"].alias("s"), free(x["s"], x["b"], a).alias("free"))
    )
    marked = _let(spans, lambda all_: mark(all_, reached(all_), ahead(all_)))
    return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: x["s"])


def scan(documents: DataFrame, model: Model, *, text_col: str = "text", base_as: str = "base_spans", all_as: str = "all_spans") -> DataFrame:
    """documents with two more columns: base spans and all spans, arrays of (start, rank, stop, kind, value) in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, "\x02")).otherwise(text)  # neither is in any pattern
    none = F.array().cast(_NO_SPANS)
    long_as = "_secret_long_" + "_".join(documents.columns)
    long = F.col(long_as)
    base = F.sort_array(F.concat(*[F.when(_may_hold(text, kind, long) & text.rlike(likely), _spans(text, kind, rank, pattern, least)).otherwise(none) for rank, (kind, pattern, likely, least) in enumerate(BASE)]))
    weights = _literal(model.pairs)
    runs = F.when(long & text.rlike(TOKEN), _spans(text, MARKOV, len(BASE), f"()({TOKEN})", RUN)).otherwise(none)
    found = documents.withColumn(long_as, text.rlike(LONG)).withColumn(base_as, base)
    random = _let(runs, lambda r: F.filter(r, lambda s: score(s["value"], weights) >= model.threshold))
    every = _let(random, lambda r: F.when(F.size(r) > 0, _apart(F.sort_array(F.concat(F.col(base_as), r)))).otherwise(F.col(base_as)))
    return found.withColumn(all_as, every).drop(long_as)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    documents = documents.select("doc_id", "text")
    found = scan(documents, train(labelled_samples(documents.sparkSession, documents)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )


def redact(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents with each found span replaced by [SECRET:kind]; overlapping spans by the first one's mark."""
    names = documents.columns
    base_as, all_as = "_secret_base_" + "_".join(names), "_secret_all_" + "_".join(names)
    found = scan(documents, model, text_col=text_col, base_as=base_as, all_as=all_as)
    text = F.col(text_col)

    def cut(pieces, start, stop):
        """Code points [start, stop) of the text."""
        a, b = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
        part = lambda i, at, n: F.coalesce(F.get(pieces, i).substr(at + 1, n), F.lit(""))
        across = F.concat(part(a, start - a * PIECE, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), part(b, F.lit(0), stop - b * PIECE))
        return F.when(a == b, part(a, start - a * PIECE, stop - start)).otherwise(across)

    def replaced(pieces, spans, before):
        """before: how far the spans before each one reach."""
        new = lambda s, at: F.when(s["start"] >= at, F.concat(cut(pieces, at, s["start"]), F.lit("[SECRET:"), s["kind"], F.lit("]"))).otherwise("")
        end = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(F.zip_with(spans, before, new), ""), _let(end, lambda e: cut(pieces, e, F.length(text))))

    reach = lambda spans: _running(F.transform(spans, lambda s: s["stop"]), 0, lambda a, x: F.greatest(a, x))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = _let(pieces, lambda p: _let(reach(F.col(all_as)), lambda before: replaced(p, F.col(all_as), before)))
    return found.withColumn(text_col, F.when(F.size(all_as) > 0, clean).otherwise(text)).select(*names)
