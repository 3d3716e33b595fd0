"""Corpus pipeline: from documents to packed training sequences.

quality rules -> line dedup -> n-gram Jaccard join -> source mix -> packing.
Every stage takes (spark, docs, sf_dir), works on all rows it is given, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.line_templates import drop_recurring_lines
from evidentia.llm.mixing import mix_sources, quality_weight
from evidentia.llm.ngram_join import one_of_each
from evidentia.llm.packing import pack_documents
from evidentia.llm.repetition import quality_rules
from evidentia.llm.spark_util import n_words, table_cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document's words in recurring lines that makes it a copy as a
#: whole: the similarity of near-duplicates.
COPIED = 0.8


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject: too short (null and empty texts are)
    or too repetitive.  Equal texts are judged alike; an empty table stays so."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out of the texts.  A document with COPIED or more of
    its words in such lines isn't one with boilerplate in it but a copy; its
    text stays whole for the next stage to find its like.  No document goes;
    null texts stay null; equal texts are treated alike."""
    out = drop_recurring_lines(docs.select(*COLUMNS))
    whole = F.col("n_words_dropped") >= COPIED * F.col("n_words")
    text = F.when(whole | F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest id;
    repeated rows of that id all do.  Rows without an id, and texts without
    words, link with nothing and stay."""
    return one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The source mix: a document is there as often as the mix takes it, once
    or twice; texts without words aren't taken.  Null sources are a source.
    Rows that are equal in all columns tie, and any of them is as good."""
    mixed = mix_sources(docs.select(*COLUMNS), n_words(F.col("text")), quality_weight(F.col("text")))
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed.filter("taken > 0").withColumn("_t", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of at most 2048; a null text is its end mark alone,
    repeated rows are packed one by one, an empty table gives no sequences."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("source_mix", mix),
    ("packing", pack),
]

#: Hashed sampling keys and the genetic search have no SQL form; the tests
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table_cut(docs)
    return docs
