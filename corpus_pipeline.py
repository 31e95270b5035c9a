"""A corpus from documents to token ids, in five stages; each stage is written and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents; the last returns token ids. A stage's cases with nulls and ties are those of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bbpe, langid, mixing, ngram_join, quality
from plumbline.llm.common import stored, table

#: Half of a text in one language, which fits much better than all others, has this score.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")  # whatever else docs has stays as it is
    return quality.judge(rows, table(spark, sf_dir, "labels")).filter("kept").select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go: those without a letter, and those whose score, the share of letters in the
    language that most words were labelled with times how much better it fits than the next, is below LEAST_SCORE."""
    model = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, names=("_lang_pred", "_lang_score"))
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles have a similarity of 0.8 or more, chains included, the least id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never."""
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every row."""
    return bbpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: Learned rules and models have no SQL form; the tests hold run() against the operators one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k + 1}")
    return docs
