"""The corpus pipeline: language, near-duplicates, repeated passages, mixing, packing. Each stage works on what the last one kept.

Defined results: a null text, or one without letters, has no language and goes in the first stage; of rows that are near
copies, or repeat, one stays; with a character that a cut falls into all its bytes go; rows of a source are taken up to three
times by mixing, and are then packed as often. Very long texts stay whole up to packing, which cuts them into pieces. Stages
return the columns of documents, but for the last, which returns the packed pieces; `packing.sequences` turns these and the
mixed documents into token ids. Empty tables pass through; extra columns stay until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm import jaccard, langid, mixing, packing, suffix
from braidlake.llm._common import Workspace, documents

#: A document is rejected if no language is found in it, or none that is likelier than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predicted = langid.predict(docs, langid.train(docs))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return predicted.where(sure).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.remove(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mix), ("packing", pack)]

#: The stages sum over segmentations, follow links and cut by repeated bytes: no SQL. tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Workspace(spark, "pipeline") as ws:
        for k, (name, stage) in enumerate(STAGES):
            docs = ws.table(stage(spark, docs, sf_dir), f"stage{k}{name}", keep=k + 1 == len(STAGES))
            if k:
                ws.drop(f"stage{k - 1}{STAGES[k - 1][0]}")
    return docs
