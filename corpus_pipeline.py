"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage's result is
written as Parquet to the shared folder and read again as the next one's input, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tabulon.llm.common import Cut, read_table
from tabulon.llm.queries import tokenizer_path, toxicity_model

#: The score from which on a document is rejected.
TOXIC_FROM = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The field is learned from the labelled rows outside the held-out fifth."""
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), output="toxicity_score")
    return scored.where(f"toxicity_score < {TOXIC_FROM}").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.selectExpr("doc_id", "lang", "source", "CAST(size(ids) AS BIGINT) AS n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", encode),
]

#: The field's scores and the tokenizer are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return docs
