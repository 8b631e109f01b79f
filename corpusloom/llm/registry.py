"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, embedding_dedup, language, merkle, ngram_join, packing, ranked_search, secrets, training_order, url_filter, warc
from .common import table


def op1_url_filter(spark, sf_dir):
    return url_filter.page_report(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark, sf_dir):
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    return chat.conversation_report(table(spark, sf_dir, "conversations"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_training_order(spark, sf_dir):
    return training_order.training_order(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search_report(spark, sf_dir)


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_bpe(spark, sf_dir):
    return bpe.encoding_report(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {"op1_url_filter": url_filter.ORACLE, "op2_decontaminate": decontaminate.ORACLE, "op4_packing": packing.ORACLE, "op5_chat": chat.ORACLE, "op6_warc": warc.ORACLE, "op7_ngram_join": ngram_join.ORACLE, "op9_embedding_dedup": embedding_dedup.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
