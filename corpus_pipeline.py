"""A corpus pipeline: documents in, packed training sequences out.

Stages, in order: toxicity (rejected documents go), quality classifier (rejected documents go), SimHash
near-dedup (one document of each group stays), secret scans (spans of secrets are replaced by a mark;
the documents stay) and best-fit packing (a row for each piece). Every stage takes all that the one before
it kept, and all but the last return the columns of documents. Stages that run Python get texts in small Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import neardup, packing, quality_crf, secrets, toxicity
from lathe.llm.common import durable, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't take for toxic; fitted on labelled documents."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field takes for good; fitted on labelled documents."""
    small_batches(spark)
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, field).where("quality_predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group."""
    small_batches(spark)
    return neardup.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where that changed the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.packed_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_bad),
    ("SimHash near-dedup", drop_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]
#: Fitted models can't be stated in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name.lower().replace(" ", "-"))
    return docs
