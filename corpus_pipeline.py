"""A corpus pipeline: language ID, near-dedup, decontamination, secret redaction, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the next stage's docs.  All but the last return the columns of ``docs``; a null in any column, an
empty table and other columns are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import bpe, decontam, langid, minhash, secrets
from chronoframe.llm.common import read, write_table
from chronoframe.llm.queries import language_model

#: Share of letters in one language under which a document isn't in a language.
MIN_LANGUAGE_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no language with the wanted share of them.
    Where no document has a language label there is nothing to learn, and all stay."""
    model = language_model(docs)
    if not model.langs:
        return docs
    found = langid.predict(docs, model)
    return (found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE))
            .select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near-duplicates on five-word shingles the one with the smallest doc_id stays.
    Texts that share a doc_id, or have none, are documents each; rows equal in both are one."""
    return minhash.keep_one(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, each text of a doc_id on its own."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars follows."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every text; the digest is that of the decoded ids."""
    coded = bpe.encode(docs, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("byte_bpe", token_ids),
]

#: No stage but the near-dedup can be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs
