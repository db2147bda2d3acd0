"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before kept, written as Parquet in between. The quality classifier rejects poor documents; line dedup cuts templates
that recur over documents, and documents of which that leaves under a fifth; one document of each near-duplicate group stays; documents that leak benchmark
items go; what is left is tokenised and packed into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import decontaminate, lines, minhash, packing, quality
from hyperloom.llm.common import free, remainder, stored

#: A document that line dedup leaves less than this share of its characters goes.
LEAST_LEFT = 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier learns from labelled rows outside the held-out fifth.

    Null and empty texts score the sample's share of good rows; repeated rows score alike; further columns of any name stay; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels, remainder("doc_id", 5) != 0))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; ``n_chars`` follows the text, and documents of which under ``LEAST_LEFT`` is left go.

    Null and empty texts and rows of a null doc_id stay as they are; repeated rows and ties as in ``lines.dedup``; further columns of any name stay; an empty table gives no rows.
    """
    before, n_lines, n_dropped = free(docs, "before", "lines", "dropped")
    out = lines.dedup(docs.withColumn(before, F.length("text")), n_lines, n_dropped)
    left = F.col(n_dropped).isNull() | (F.col(n_dropped) == 0) | (F.length(F.trim("text")) >= LEAST_LEFT * F.col(before))
    out = out.where(left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id; nulls, empty texts and repeated rows as in ``minhash.dedup``."""
    return minhash.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; nulls, empty texts and repeated rows as in ``decontaminate.clean``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids; nulls, empty texts and repeated rows as in ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Fitted models, templates, estimates and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
