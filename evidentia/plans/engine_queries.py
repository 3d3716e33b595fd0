"""Queries over a store that the engine has filled from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.running import numbered
from evidentia.plans.api import Engine
from evidentia.plans.queries import query, t
from evidentia.plans.sql import SEARCHES
from evidentia.sources.pages import TableSource
from evidentia.sources.shared import shared_folder

#: Roots of the stores that were filled, by application and input.
_FILLED: dict[tuple[str, str], str] = {}
CASES = 8


def filled(spark: SparkSession, d: str) -> Engine:
    """Conversations as pages of eight cases, taken in twice: first two thirds of
    them, half of those with other texts, then all as they are."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FILLED:
        root = f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}"
        c = t(spark, d, "conversations").select(F.concat(F.lit("case-"), F.col("conv_id") % CASES).alias("case_id"), "conv_id", "turn", "text")
        pages = numbered(c.withColumn("_b", F.floor(F.col("conv_id") / 1024)), ["case_id"], ["_b"], ["conv_id", "turn"], "page").select("case_id", F.col("page").cast("int").alias("page"), "text")
        pages.write.parquet(f"{root}/in/all")
        once = spark.read.parquet(f"{root}/in/all").filter("page % 3 < 2")
        once.withColumn("text", F.when(F.col("page") % 3 == 1, F.lit("an older text of this page, long enough to be read")).otherwise(F.col("text"))).write.parquet(f"{root}/in/some")
        e = Engine(spark, f"{root}/store")
        e.store.n_buckets  # noqa: B018 - fixes the store's buckets
        for part in ("some", "all"):
            e.create_case(TableSource(f"{root}/in/{part}"), now="2024-05-01 00:00:00")
        _FILLED[key] = e.root
    return Engine(spark, _FILLED[key])


@query
def engine_ledger(spark: SparkSession, d: str) -> DataFrame:
    led = filled(spark, d).store.read("page_ledger")
    return led.select("case_id", "page", "page_hash", "state", "piece_type", "native_text_chars", F.element_at("evidence_ids", 1).alias("evidence_id"))


@query
def engine_status(spark: SparkSession, d: str) -> DataFrame:
    s = filled(spark, d).status()
    return s.select("case_id", "total_pages", F.col("n_needs_ocr").cast("long").alias("n_needs_ocr"), "estimated_pages")


@query
def engine_units(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with the place that the engine's reading order gives it."""
    u = filled(spark, d).evidence()
    return u.select("case_id", F.col("position").cast("long").alias("position"), "evidence_id", "hash", F.md5("text").alias("text_md5"))


@query
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """Searches in one case over its stored index."""
    hits = filled(spark, d).search("case-1", [q for _, q in SEARCHES], 10)
    return hits.select("query_id", "evidence_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "page")


@query
def engine_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Estimates as they were written back, with two cases approved."""
    e = filled(spark, d)
    e.approve("case-0", 5, 10)
    e.approve("case-3", 7, 20)
    return e.store.read("approvals").select("case_id", F.coalesce("approved", F.lit(False)).alias("approved"), "estimated_pages", "max_pages", "max_calls")


@query
def engine_resumed(spark: SparkSession, d: str) -> DataFrame:
    """What a second reading of the same pages would still have to take in."""
    e = filled(spark, d)
    from evidentia.functions.identity import sha256
    from evidentia.operators.coverage import skip_extracted

    pages = TableSource(f"{e.root.removesuffix('/store')}/in/all").pages(spark)
    todo = skip_extracted(pages.withColumn("hash", sha256(F.coalesce(F.col("text"), F.lit("")))), e.store.read("page_ledger"))
    return todo.select("case_id", "page")
