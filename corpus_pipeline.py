"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again as the next one's docs. All stages but the last return the
columns of documents, whatever they are called; the last returns pieces of packed sequences. An
empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fmindex, jaccard, packing, quality, secrets
from millrace.llm.common import checkpoint_folder, table
from millrace.llm.queries import TOKENIZER
from millrace.sources.publish import Folders


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the base rules or the learned decision list reject, null and empty texts among them; ids play no part in it."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar ones: that of the least id, a null id last; of rows equal in id and text one. Rows without words stay."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that benchmark passages contaminate, each judged by its own text; null texts are clean."""
    return fmindex.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and linked credential parts in the texts; n_chars follows. Null texts stay null; no row goes."""
    masked = secrets.mask_credentials(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows, repeated ones too; a null text is empty and still has its end."""
    return packing.pack(docs, **TOKENIZER)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", mask_secrets), ("packing", pack)]

#: The decision list is learned and packing depends on how rows are dealt; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is a table in the shared folder, deleted once the next one is written. The last one's stays, since the result reads it."""
    out = table(spark, sf_dir, "documents")
    root = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    folders = Folders(spark, root)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        out.write.parquet(f"{root}/{k}")
        out = spark.read.parquet(f"{root}/{k}")
        if k:
            folders.delete(f"{root}/{k - 1}")
    return out
