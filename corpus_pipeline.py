"""Corpus preparation in five stages: quality rules, toxicity, near duplicates, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import bpe, decontaminate, jaccard_join, quality_rules, toxicity
from pairwright.llm.common import discard, materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them those with a null or empty text; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels of documents that are left.

    A null text scores as an empty one; equal texts score alike, so repeated rows go or stay together; without labels all stay.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 80 percent the one with the smallest doc_id stays; texts without words and null doc_ids stay."""
    return jaccard_join.keep_one(docs, jaccard_join.Join(words=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts and null items hold and are nothing."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256) of what is left, a row for each row; a null text is an empty one."""
    found = bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY), digests=True, keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", encoded),
]

#: Trained and tokenizer stages have no SQL; tests hold each stage, and the whole run, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each stage's rows are written to the shared folder and read again, until the next's are."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "stage")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
