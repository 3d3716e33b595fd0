"""Files of many pages: counted from the header, read in blocks, settled pages unparsed."""

import zipfile

from pyspark.sql import functions as F

from evidentia.plans.api import Engine
from evidentia.sources.paged import PagedSource, ZipPages


def archive(path, texts):
    with zipfile.ZipFile(path, "w") as z:
        for i, t in enumerate(texts):
            z.writestr(f"p{i:06d}.txt", t)


def counting(log):
    class Counting(ZipPages):  # local, so that it travels to the workers by value
        def page(self, doc, number):
            with open(log, "a") as f:
                f.write(f"{number}\n")
            if number == 77:
                raise ValueError("bad page")
            return super().page(doc, number)

    return Counting()


def test_ten_thousand_pages(spark, tmp_path):
    """Read by many tasks; of one file in several, and only what isn't settled."""
    archive(tmp_path / "Large Case.zip", [f"page {i + 1} of  a large\n case" for i in range(9_000)])
    archive(tmp_path / "small.zip", [f"page {i + 1} of a small case" for i in range(1_000)])
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    log = str(tmp_path / "log")
    source = PagedSource(str(tmp_path / "*.zip"), counting(log))
    files = {r.case_id: (r.total_pages, r.error) for r in source.files(spark).collect()}
    assert files["large-case"] == (9_000, None) and files["small"] == (1_000, None) and files["broken"][0] == 0 and files["broken"][1]
    assert {r.case_id for r in source.counts(spark).collect()} == {"large-case", "small"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = source.parsed(spark).filter("case_id = 'large-case'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 9_000
    open(log, "w").close()
    settled = spark.range(1, 9_001).select(F.lit("large-case").alias("case_id"), F.col("id").alias("page")).filter("page % 100 <> 77")
    got = source.parsed(spark, settled).collect()
    assert len(got) == 90 + 1_000 and len(open(log).readlines()) == len(got)
    assert {(r.case_id, r.error) for r in got if r.page == 77} == {("large-case", "ValueError: bad page"), ("small", "ValueError: bad page")}
    assert {r.text for r in source.pages(spark, settled).filter("case_id = 'large-case' AND page = 177").collect()} == {"page 177 of a large case"}


def test_engine_takes_the_files_own_count(spark, tmp_path):
    """The count is the file's, and a second run parses what isn't settled."""
    long = "PETIÇÃO INICIAL com texto bastante para uma leitura segura da página, sem carimbos. "
    archive(tmp_path / "caso.zip", [long + str(i) for i in range(5)] + ["", ""])
    log = str(tmp_path / "log")
    source = PagedSource(str(tmp_path / "*.zip"), counting(log))
    e = Engine(spark, str(tmp_path / "store"))
    e.create_case(source, now="2024-05-01 00:00:00")
    assert e.store.read("cases").first().total_pages == 7 and e.store.read("page_ledger").count() == 7
    first = len(open(log).readlines())
    e.create_case(source, now="2024-05-02 00:00:00")
    assert sorted({int(x) for x in open(log).readlines()[first:]}) == [6, 7]


def test_openings_do_not_grow_with_the_pages(spark, tmp_path):
    """Opening an archive reads its whole directory: once a task, not once a block."""
    log = str(tmp_path / "log")

    class Opened(ZipPages):
        def open(self, file):
            with open(log, "a") as f:
                f.write("x\n")
            return super().open(file)

    archive(tmp_path / "a.zip", [f"page {i}" for i in range(4_000)])
    source = PagedSource(str(tmp_path / "*.zip"), Opened(), block_pages=8)
    assert source.parsed(spark).filter("error IS NULL").count() == 4_000
    # 500 blocks, dealt to two tasks a core; and the count of the pages
    assert len(open(log).readlines()) <= 2 * spark.sparkContext.defaultParallelism + 3
