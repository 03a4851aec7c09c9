"""The corpus pipeline: documents in known languages, one of each group of near copies, without secrets, mixed and packed.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and read again as the docs
of the next. All stages but the last return the columns of ``documents``, whatever others there are. NULLs, empty and very
long texts, repeated rows and empty tables are treated as the operators say.

The tables of the steps inside a stage are deleted when the next stage begins: its docs are written by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithgraph.llm import jaccard, language, mixing, packing, secrets
from kithgraph.llm.common import prepare, scratch
from kithgraph.session import few_files, shared_folder, stage_steps


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the language that was predicted is kept as ``lang``."""
    with stage_steps(prepare(spark), first=True):
        nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        judged = language.predict(nested, language.fit(docs), "doc.text").filter(F.col("lang_pred") != language.UNKNOWN)
        return few_files(judged.select(F.col("doc").withField("lang", F.col("lang_pred")).alias("doc")).select("doc.*"), docs.count())


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    with stage_steps(prepare(spark)):
        return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    with stage_steps(prepare(spark)):
        return few_files(secrets.redact(docs, secrets.open_ledger(spark, scratch(spark, "ledger"))), docs.count())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and with as many of their words, as the targets of their sources ask for."""
    with stage_steps(prepare(spark)):
        return few_files(mixing.mixed_documents(docs), docs.count())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document of the mix is packed.

    Near copies of other documents are gone since the second stage; what the mix took of one document, once or thrice, never
    shares a bin.
    """
    with stage_steps(prepare(spark)):
        return packing.pack(docs)


STAGES = [
    ("language", language_stage), ("near_copies", near_copies_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage),
]

# Language models and near copies over hashes are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
