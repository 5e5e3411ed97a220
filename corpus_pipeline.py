"""Corpus pipeline: toxicity, exact copies, near copies, benchmark passages, packing.

Every stage takes all rows that the stage before it kept, and its decision takes effect: what it
rejects is not in its result.  Results are written as Parquet in the shared folder and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import Workspace
from tracewell.llm.decontaminate import decontaminate
from tracewell.llm.exact_dedup import exact_dedup
from tracewell.llm.jaccard_join import near_dedup
from tracewell.llm.packing import pack
from tracewell.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity probability reaches the threshold.

    Null, empty and wordless texts stay; equal texts are decided alike; ids may be null or repeat.
    """
    return drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest id of equal texts.

    A null text equals an empty one; null ids lose against any other; of wholly equal rows one stays.
    """
    return exact_dedup(spark, docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of documents linked at 80 % of five-word shingles.

    Texts without words are linked with nothing and stay; null or repeated ids are numbered anew inside.
    """
    return near_dedup(spark, docs, percent=80, shingle=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold windows of two benchmark items or more.

    Null and empty texts stay; a row is told by its id and text.
    """
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; one row per piece.

    A null text is empty and has its end id alone; an empty table gives no rows, here as in all stages.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packing),
]

#: SQL does not express the trained classifier of the first stage; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
