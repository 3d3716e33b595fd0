"""Small Spark helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.shared import shared_folder

#: The separators of the word rule `[^\x20\x09-\x0D]+`.
WORD_RE = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes checkpoints, shuffle files and broadcasts that nothing
    refers to any more when the driver's JVM collects garbage, and not before:
    loops that make many ask for it."""
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def text_chars(docs: DataFrame) -> int:
    """Characters of all texts (one cheap JVM aggregate)."""
    return int(docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0])


def table_cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the checkpoint folder and read it
    again: for wide rows, which a checkpoint would store uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: in loops of many small joins each
    broadcast would leave a table in the driver's memory until it is cleaned."""
    return df.hint("merge")


#: Keys that get salts of their own in ``salted_join``, at most.
MOST_HOT = 100_000


def salted_join(big: DataFrame, small: DataFrame, on: list[str], n: str, salt_by: list[str], floor: int = 1000, sums: tuple[int, int] | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key and in
    ``n`` the number of its rows in ``big``; no task gets many rows of one key.

    A key with more rows than ``floor`` and than a MOST_HOT-th of all is dealt
    by a hash of ``salt_by`` to parts of that many rows, and its row in
    ``small`` is repeated for each.  By that rule there are fewer than MOST_HOT
    such keys, so their list is broadcast.  ``sums`` are the sum and the largest
    of ``n``, if they are known.
    """
    total, top = sums or small.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    most = max(floor, int(total) // MOST_HOT)
    if top <= most:
        return big.join(merged(small), on)
    parts = F.greatest(F.ceil(F.col(n) / F.lit(most)), F.lit(1)).cast("long")
    hot = small.filter(F.col(n) > most).select(*on, parts.alias("_parts"))
    a = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by, F.lit(23)), F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return a.join(merged(b), [*on, "_salt"]).drop("_salt")
