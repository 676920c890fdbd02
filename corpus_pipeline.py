"""A training corpus from raw documents: rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents, whatever these are besides doc_id, text and source. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm import bpe, mixing, neardup, quality, secretscan
from wayside.llm.common import discard, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the rules or whose host is rejected.

    Null and empty texts fail for want of words; repeated rows are judged one by one; a null source is a host of its own.
    """
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id.

    Rows that repeat the document that stays stay too; null texts, texts without words and null doc_ids are near to nothing.
    """
    return neardup.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones included, give way to their kind in brackets.

    No row is dropped; null and empty texts stay as they are.
    """
    return secretscan.redact_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, from 0 to 3 times.

    A null source comes last; null texts have no size and are repeated like others of their source.
    """
    return mixing.mix_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the text that they decode to.

    Null and empty texts have no ids. Repeated rows are encoded one by one; only doc_id, lang and source stay of the columns.
    """
    return bpe.round_trip(docs, bpe.tokenizer_file()).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can't express merging words by rank; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written before the next reads it, and deleted after that has been written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
            if i:
                discard(before)
    return docs
