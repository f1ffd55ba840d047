"""A corpus pipeline: toxicity, language, near-duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the next one. All
but the last return the columns of documents. Rows with nulls go through every stage; a null text has no letters, so the language stage
rejects it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, decontaminate, language, ngramjoin, toxicity
from veilspark.llm.common import materialise, read

#: A document's toxicity score from which it goes.
MOST_TOXIC = 0.5
#: A document's language score below which it goes, as do documents without letters.
LEAST_LANGUAGE = 0.3
#: Near-duplicates share at least so many percent of their shingles of so many words (op4's 3 words and 90 % bind that query only).
NEAR_WORDS, NEAR_SHARE = 5, 80


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str, str], DataFrame], keep: str) -> DataFrame:
    """Rows of docs that a scoring operator lets pass. Columns get names of their own meanwhile, so none can clash with the operator's."""
    names = docs.columns
    own = docs.toDF(*(f"_c{k}" for k in range(len(names))))
    judged = judge(own, f"_c{names.index('doc_id')}", f"_c{names.index('text')}")
    return judged.filter(keep).select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the random field finds toxic."""
    field = toxicity.fitted(docs, read(spark, sf_dir, "labels"))
    return _kept(docs, lambda d, i, t: toxicity.score_documents(d, field, i, t, keep=True), f"score < {MOST_TOXIC}")


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language can't be told; without any usable label, only the former."""
    machines = language.fitted(docs)
    if machines is None:
        return docs.filter(F.col("text").rlike(language.LETTER))
    return _kept(docs, lambda d, i, t: language.identify(d, machines, i, t, keep=True), f"lang_pred <> 'und' AND score >= {LEAST_LANGUAGE}")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return ngramjoin.one_of_each(docs, size=NEAR_WORDS, share=NEAR_SHARE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_a_language),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: SQL can't express the stages that learn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
