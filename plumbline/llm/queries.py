"""The queries and SQL of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, bbpe, filter_audit, langid, lm, media, mixing, ngram_join, quality, records, sharding, simhash, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.members(spark, media.write_archives(table(spark, sf_dir, "documents"))))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return records.read_back(spark, folder)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.Join(table(spark, sf_dir, "documents"), n=4, percent=85).run().select("doc_id", "n_shingles", "component_id")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.learn(docs.filter(~lm.held_out(F.col("doc_id"))))
    found = lm.score(docs, model, counts)
    return found.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_media": op2_media,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_langid": op6_langid,
    "op7_sharding": op7_sharding,
    "op8_records": op8_records,
    "op9_jaccard": op9_jaccard,
    "op10_lm": op10_lm,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_filter_audit": op13_filter_audit,
}
SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op9_jaccard": ngram_join.SQL, "op13_filter_audit": filter_audit.SQL}
