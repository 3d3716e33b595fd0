"""Files of many pages, read by (file, block of pages).

Pages of a file are counted from its header, in tasks; pages that are settled
already are taken out before anything is parsed; what is left is dealt out by
blocks of pages in their order, so that a task has neighbouring blocks of few
files and opens each once: opening may cost as much as the file has pages.  The
parser is plugged in; archives of page files are built in.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from typing import IO, Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import case_slug, collapse
from evidentia.sources.pages import with_need
from evidentia.sources.shared import written

#: Pages of a file that stay in one task, and tasks for each core.
BLOCK_PAGES, TASKS_PER_CORE = 64, 2


class PageParser(Protocol):
    """Runs on executors.  ``open`` gives whatever the other two need."""

    def open(self, file: IO[bytes]) -> Any: ...

    def count(self, doc: Any) -> int: ...

    def page(self, doc: Any, number: int) -> str:
        """The text of a page, from 1."""
        ...


class ZipPages:
    """Archives with a text file for each page, in the order of their names; the
    archive's directory tells how many there are."""

    def open(self, file: IO[bytes]) -> tuple[zipfile.ZipFile, list[str]]:
        z = zipfile.ZipFile(file)
        return z, sorted(n for n in z.namelist() if not n.endswith("/"))

    def count(self, doc: tuple[zipfile.ZipFile, list[str]]) -> int:
        return len(doc[1])

    def page(self, doc: tuple[zipfile.ZipFile, list[str]], number: int) -> str:
        return doc[0].read(doc[1][number - 1]).decode("utf-8", "replace")


def open_any(path: str) -> IO[bytes]:
    """A file of any store that Arrow knows, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, at = fs.LocalFileSystem(), path[5:] if not path.startswith("file://") else path[7:]
    else:
        store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


class PagedSource:
    """A page source over files of many pages, one case each.

    ``path`` is what Spark's reader of binary files takes; their contents aren't
    read by it.  A file whose header can't be read has no pages and its error in
    ``files``; a page that can't be parsed has an empty text, so that it goes to
    enrichment, and its error in ``parsed``.
    """

    def __init__(self, path: str, parser: PageParser, block_pages: int = BLOCK_PAGES, opener: Callable[[str], IO[bytes]] = open_any):
        self.path, self.parser, self.block_pages, self.opener = path, parser, block_pages, opener

    def files(self, spark: SparkSession) -> DataFrame:
        """(case_id, path, total_pages, error) of each file."""
        parser, opener = self.parser, self.opener

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pages, errors = [], []
                for path in b.column("path").to_pylist():
                    try:
                        with opener(path) as f:
                            pages.append(parser.count(parser.open(f)))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - a broken file is reported, not fatal
                        pages.append(0)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([b.column("case_id"), b.column("path"), pa.array(pages, pa.int32()), pa.array(errors, pa.string())], names=["case_id", "path", "total_pages", "error"])

        listed = spark.read.format("binaryFile").load(self.path).select(case_slug("path").alias("case_id"), "path")
        return listed.repartition("path").mapInArrow(run, "case_id string, path string, total_pages int, error string")

    def counts(self, spark: SparkSession) -> DataFrame:
        """(case_id, total_pages) as the files themselves say."""
        return self.files(spark).filter("error IS NULL").select("case_id", "total_pages")

    def parsed(self, spark: SparkSession, settled: DataFrame | None = None) -> DataFrame:
        """(case_id, page, text, error) of the pages that aren't among
        ``settled`` (case_id, page)."""
        parser, opener = self.parser, self.opener
        todo = self.files(spark).filter("total_pages > 0").select("case_id", "path", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page"))
        if settled is not None:
            todo = todo.join(settled.select("case_id", F.col("page").cast("int").alias("page")), ["case_id", "page"], "left_anti")
        # written, as finding the ranges reads it too; the number of tasks is fixed, so that openings don't grow with the pages
        todo = written(todo.withColumn("_b", F.floor((F.col("page") - 1) / self.block_pages)).select("case_id", "path", "_b", "page"))
        todo = todo.repartitionByRange(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "path", "_b").sortWithinPartitions("path", "page")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, file, doc = None, None, None
            try:
                for b in batches:
                    texts, errors = [], []
                    for path, page in zip(*(b.column(c).to_pylist() for c in ("path", "page"))):
                        text, error = "", None
                        try:
                            if path != at:
                                if file is not None:
                                    file.close()
                                at, file = None, opener(path)
                                doc = parser.open(file)
                                at = path
                            text = parser.page(doc, page)
                        except Exception as e:  # noqa: BLE001 - a page's failure is the page's
                            error = f"{type(e).__name__}: {e}"
                        texts.append(text)
                        errors.append(error)
                    yield pa.RecordBatch.from_arrays([b.column("case_id"), b.column("page"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["case_id", "page", "text", "error"])
            finally:
                if file is not None:
                    file.close()

        return todo.mapInArrow(run, "case_id string, page int, text string, error string")

    def pages(self, spark: SparkSession, settled: DataFrame | None = None) -> DataFrame:
        return with_need(self.parsed(spark, settled).select("case_id", "page", collapse("text").alias("text")))
