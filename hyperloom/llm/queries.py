"""The registered queries of the training-data operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder

#: The key of the registered query; a deployment sets a secret one.
PII_KEY = "registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup

    return dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict, train

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    scored = predict(docs, train(docs, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digests, pack

    return digests(pack(_table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, pseudonymise

    out = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", *[f"n_{k}" for k in KINDS])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import hits

    return hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    scored = score(docs, train(docs, _table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(_table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import groups

    return groups(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan, summary

    return summary(scan(_table(spark, sf_dir, "documents")))


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit import digests, pack

    return digests(pack(_table(spark, sf_dir, "documents")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine

    return mine(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lines, op2_langid, op3_packing, op4_pii, op5_decontaminate, op6_quality, op7_topk, op8_minhash, op9_warc, op10_licences, op11_bestfit, op12_centroids, op13_collocations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import centroids, collocations, minhash, pii, topk, warc

    return {
        "op4_pii": pii.oracle(PII_KEY), "op7_topk": topk.ORACLE, "op8_minhash": minhash.ORACLE, "op9_warc": warc.ORACLE, "op12_centroids": centroids.ORACLE, "op13_collocations": collocations.ORACLE,
    }
