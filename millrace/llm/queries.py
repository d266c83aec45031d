"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import (bpe, embedding_dedup, lexical, licenses, mixing, neighbours, perspectives, pii, secrets,
                          simhash, spelling, token_files, toxicity)
from millrace.llm.common import load, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("op1_pii")
def op1(spark, folder):
    return pii.report(load(spark, folder, "documents"))


@query("op2_token_files")
def op2(spark, folder):
    return token_files.written_report(load(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), 2)


@query("op3_neighbours")
def op3(spark, folder):
    return neighbours.nearest(load(spark, folder, "embeddings"))


@query("op4_simhash")
def op4(spark, folder):
    return simhash.near_duplicates(load(spark, folder, "documents"))


@query("op5_embedding_dedup")
def op5(spark, folder):
    return embedding_dedup.near_duplicates(load(spark, folder, "embeddings"))


@query("op6_mixing")
def op6(spark, folder):
    return mixing.taken_words(load(spark, folder, "documents")).drop("h")


@query("op7_perspectives", perspectives.SQL)
def op7(spark, folder):
    return perspectives.dialogues(load(spark, folder, "conversations"))


@query("op8_bpe")
def op8(spark, folder):
    return bpe.round_trip(load(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@query("op9_toxicity")
def op9(spark, folder):
    return toxicity.flagged(load(spark, folder, "documents"), load(spark, folder, "labels"))


@query("op10_licenses", licenses.SQL)
def op10(spark, folder):
    return licenses.scan(load(spark, folder, "documents"))


@query("op11_secrets")
def op11(spark, folder):
    return secrets.scan(load(spark, folder, "documents"))


@query("op12_lexical", lexical.SQL)
def op12(spark, folder):
    return lexical.search(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


@query("op13_spelling")
def op13(spark, folder):
    return spelling.variants(load(spark, folder, "documents"))
