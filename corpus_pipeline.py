"""The document pipeline: STAGES, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir).  All but the last return the columns of
documents; the last returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language, ngram_join, packing, secrets
from corpusloom.llm.common import materialize, release, table


def identify_language(spark, docs, sf_dir):
    """Learns from the labelled documents that are not held out; those that the decoding finds in no learned language go.

    A null lang becomes the predicted one.
    """
    return language.keep_identified(docs, language.train(docs, where=~language.is_held_out()))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of n-gram Jaccard links stays: the one with the least id."""
    return ngram_join.keep_one_of_each(docs)


def drop_benchmark_texts(spark, docs, sf_dir):
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Found secrets are replaced by their kind's mark; n_chars follows the text."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(spark, docs)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack_sequences(spark, docs, sf_dir):
    """Sequences in optimal length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_texts),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Language identification is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
