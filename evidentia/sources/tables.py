"""JSON artifacts and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from evidentia.functions.text import fold, python_fold
from evidentia.schemas import DEADLINE, DEADLINE_FILE, PHASES


def json_artifact(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """A JSON document or list of them; empty if it is missing and not required."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def load_deadlines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a deadline file, with its version.  A reference file is small
    (a dimension of hundreds of rows); Spark broadcasts it by its size."""
    f = json_artifact(spark, path, DEADLINE_FILE, required=True)
    return f.select(F.explode("prazos").alias("p"), F.col("versao").alias("versao_tabela")).select("p.*", "versao_tabela")


def find_deadlines(table: DataFrame, text: str | None = None, columns: tuple[str, ...] = ("ato", "tipo", "base_legal")) -> DataFrame:
    """Rows one of whose columns holds ``text``, both folded; all without it."""
    if not text:
        return table
    wanted = python_fold(text)
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(fold(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted))
    return table.filter(test)


def load_phases(spark: SparkSession, path: str) -> DataFrame:
    return json_artifact(spark, path, PHASES)


def pieces_of_phase(phases: DataFrame, area: str, fase_id: str | None = None) -> DataFrame:
    """Phases of an area in their order, or the pieces of one."""
    p = phases.filter(F.col("area") == area)
    if fase_id is None:
        return p.select("fase_id", "fase", "ordem").orderBy("ordem")
    return p.filter(F.col("fase_id") == fase_id).select("fase_id", F.posexplode("pecas").alias("ordem", "p")).select("fase_id", "ordem", "p.*")


# ---------------------------------------------------------------- folders of cases


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, modified) of the files that a pattern names; none: empty."""
    try:
        df = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, value string, modified timestamp")
    named = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(named.alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def folder_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(case_id, json, broken, raw, modified): the file ``name`` of every case
    folder below ``root``.  One that isn't JSON is there as ``raw``, marked
    broken, beside the good ones."""
    pattern = "([^/]+)/" + name.replace(".", "\\.") + "$"
    f = whole_files(spark, f"{root}/*/{name}").withColumn("json", F.try_parse_json("value"))
    return f.select(F.regexp_extract("path", pattern, 1).alias("case_id"), "json", F.col("json").isNull().alias("broken"), F.when(F.col("json").isNull(), F.col("value")).alias("raw"), "modified")


def case_folders(spark: SparkSession, root: str) -> DataFrame:
    """Every folder below ``root`` that has a case.json: case_id, status,
    total_pages, alertas, atualizado_em, partes, valor_causa,
    documentos_no_caderno, achados_no_dossie, broken.

    Status, case file and findings are looked at in this order; from a broken one
    on nothing more is told of its case, which is listed all the same.  Counts
    of nothing are null.
    """
    cases = spark.createDataFrame([], "case_id string")
    try:
        cases = spark.read.format("binaryFile").load(f"{root}/*/case.json").select(F.regexp_extract("path", r"([^/]+)/case\.json$", 1).alias("case_id"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    get = lambda path, kind: F.try_variant_get("json", path, kind)
    some = lambda n: F.when(n > 0, n)
    person = "array<struct<papel:string,nome:string>>"
    named = F.filter(get("$.partes", person), lambda p: F.length(F.coalesce(p["nome"], F.lit(""))) > 0)
    said = lambda p: F.concat(F.substring(p["nome"], 1, 60), F.when(F.length(F.coalesce(p["papel"], F.lit(""))) > 0, F.concat(F.lit(" ("), p["papel"], F.lit(")"))).otherwise(""))
    status = folder_artifact(spark, root, "status.json").select("case_id", F.col("broken").alias("_b1"), F.when(~F.col("broken"), F.struct(get("$.status", "string").alias("status"), get("$.total_pages", "int").alias("total_pages"), some(F.size(get("$.alerts", "array<variant>"))).alias("alertas"), F.col("modified").alias("atualizado_em"))).alias("_s"))
    facts = folder_artifact(spark, root, "artifacts/case_file.json").select("case_id", F.col("broken").alias("_b2"), F.when(~F.col("broken"), F.struct(F.transform(named, said).alias("partes"), get("$.valor_causa.valor", "string").alias("valor_causa"), some(get("$.caderno.total_documentos", "int")).alias("documentos_no_caderno"))).alias("_f"))
    found = folder_artifact(spark, root, "artifacts/dossie.json").select("case_id", F.col("broken").alias("_b3"), some(F.size(get("$", "array<variant>"))).alias("_n"))
    x = cases
    for part in (status, facts, found):
        x = x.join(part, "case_id", "left")
    first, second = F.coalesce("_b1", F.lit(False)), F.coalesce("_b2", F.lit(False))
    return x.select(
        "case_id", "_s.*", *(F.when(~first, F.col(f"_f.{c}")).alias(c) for c in ("partes", "valor_causa", "documentos_no_caderno")), F.when(~first & ~second, F.col("_n")).alias("achados_no_dossie"),
        (first | second | F.coalesce("_b3", F.lit(False))).alias("broken"),
    ).orderBy(F.col("atualizado_em").desc_nulls_last(), "case_id")
