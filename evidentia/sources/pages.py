"""Page sources: anything that gives (case_id, page, text) rows.

A page source is an object with ``pages(spark) -> DataFrame`` of ``case_id,
page, text``.  One that knows how many pages its files have says so in
``counts``; one that can leave out settled pages takes them as a second
argument.  Parquet, text files and HTML are built in; files of many pages with a
parser of their own are in ``paged``.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import SPACE, collapse

MIN_PAGE_CHARS = 20


class PageSource(Protocol):
    def pages(self, spark: SparkSession) -> DataFrame: ...


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, comments and tags out,
    the common entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return collapse(t)


def with_need(pages: DataFrame) -> DataFrame:
    """Adds needs_enrichment: fewer than 20 characters of text."""
    return pages.withColumn("needs_enrichment", F.length(F.coalesce("text", F.lit(""))) < MIN_PAGE_CHARS)


def html_pages(pages: DataFrame, case: Column, page: Column, html: str = "html") -> DataFrame:
    return with_need(pages.select(case.alias("case_id"), page.alias("page"), html_text(F.col(html)).alias("text")))


class TableSource:
    """Pages in a table of any Spark format."""

    def __init__(self, path: str, fmt: str = "parquet", case: str = "case_id", page: str = "page", text: str = "text"):
        self.path, self.fmt, self.names = path, fmt, (case, page, text)

    def pages(self, spark: SparkSession) -> DataFrame:
        c, p, t = self.names
        df = spark.read.format(self.fmt).load(self.path)
        return with_need(df.select(F.col(c).alias("case_id"), F.col(p).cast("int").alias("page"), collapse(t).alias("text")))


class TextSource:
    """One file per case, pages apart by form feeds."""

    def __init__(self, path: str):
        self.path = path

    def pages(self, spark: SparkSession) -> DataFrame:
        from evidentia.functions.text import case_slug

        df = spark.read.text(self.path, wholetext=True).select(case_slug(F.col("_metadata.file_path")).alias("case_id"), F.posexplode(F.split("value", "\f")).alias("p", "t"))
        return with_need(df.select("case_id", (F.col("p") + 1).alias("page"), collapse("t").alias("text")))


class BinarySource:
    """One binary file per case and a parser that runs on the executors:
    ``parse(content) -> list of page texts``."""

    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def pages(self, spark: SparkSession) -> DataFrame:
        from evidentia.functions.text import case_slug

        parse = self.parse

        def run(batches):
            import pandas as pd

            for pdf in batches:
                for case, content in zip(pdf.case_id, pdf.content):
                    texts = parse(bytes(content))
                    yield pd.DataFrame({"case_id": [case] * len(texts), "page": range(1, len(texts) + 1), "text": texts})

        df = spark.read.format("binaryFile").load(self.path).select(case_slug("path").alias("case_id"), "content")
        out = df.mapInPandas(run, "case_id string, page int, text string")
        return with_need(out.withColumn("text", F.trim(F.regexp_replace("text", SPACE + "+", " "))))


def total_pages(source: PageSource, spark: SparkSession) -> DataFrame:
    """(case_id, total_pages), from the files' own counts where the source has
    them: the last page that was read isn't the last there is."""
    return source.counts(spark) if hasattr(source, "counts") else page_counts(source.pages(spark))


def unsettled_pages(source: PageSource, spark: SparkSession, settled: DataFrame) -> DataFrame:
    """The source's pages; without ``settled`` (case_id, page) ones where the
    source can leave them unparsed."""
    return source.pages(spark, settled) if hasattr(source, "counts") else source.pages(spark)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("case_id").agg(F.max("page").cast("int").alias("total_pages"))
