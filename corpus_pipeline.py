"""The training-data pipeline: five stages over documents, each written and read again by the next.

1. quality: documents that the factorisation machine scores under 0.5 go.
2. near_dedup: of documents with the same words, and of documents whose five-word shingles have a similarity of 0.8 or
   more, one stays. A document goes only if it is itself so alike to one that stays, so that of a chain
   of ever more changed texts one stays for each stretch, and no two that stay are so alike.
3. decontaminate: documents with benchmark passages in at least a twentieth of their words go.
4. redact_secrets: secrets in texts are replaced by a mark; all documents stay.
5. pack: token ids in sequences of 1024; a row for each piece.

Every stage but the last returns the columns of documents and works on all rows it is given. Rows with a null
doc_id or text pass through where nothing speaks against them: null texts are scored, and are near-duplicates of
each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import decontam, packing, quality, secret_scan, simhash
from tarnlake.llm.common import docs_of, work_path, written


#: For the encoders of pack: executors come to it with heaps that near_dedup has filled, so workers keep smaller tables than op7's.
PACK_KNOWN = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(spark, docs, work_path(spark, "ledger"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs_of(docs), public_tokenizers.path("byte_bpe_50k.json"), known=PACK_KNOWN)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("redact_secrets", redact_stage),
    ("pack", pack_stage),
]

#: The classifier, near-duplicate groups and packing are not expressible; tests hold near_dedup against all pairs, and run() against its stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
