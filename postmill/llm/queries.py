"""The operators as registered queries over the given tables, and their check SQL."""

from __future__ import annotations

from ..plans.register import Registry
from . import (
    bpe, collocations, id_files, kd_search, lexical, mixing, near_dedup, packing, quality, sentence_spans, suffix_dedup, token_counts, toxicity
)

query = Registry()


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf):
    return suffix_dedup.report(table(spark, sf, "documents"))


@query("op2_near_dedup")
def op2_near_dedup(spark, sf):
    return near_dedup.components(table(spark, sf, "documents"))


@query("op3_quality")
def op3_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_id_files")
def op4_id_files(spark, sf):
    return id_files.report(table(spark, sf, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark, sf):
    return toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_token_counts")
def op6_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"))


@query("op7_bpe_tree")
def op7_bpe_tree(spark, sf):
    return bpe.encode_documents(table(spark, sf, "documents"))


@query("op8_mixing", mixing.SQL)
def op8_mixing(spark, sf):
    return mixing.report(table(spark, sf, "documents"))


@query("op9_sentence_spans")
def op9_sentence_spans(spark, sf):
    return sentence_spans.report(table(spark, sf, "documents"))


@query("op10_kd_search", kd_search.SQL)
def op10_kd_search(spark, sf):
    return kd_search.search(table(spark, sf, "embeddings"))


@query("op11_collocations", collocations.SQL)
def op11_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query("op12_lexical_search", lexical.SQL)
def op12_lexical_search(spark, sf):
    return lexical.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark, sf):
    return packing.report(table(spark, sf, "documents"))
