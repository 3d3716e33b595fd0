"""Claim verification: excerpts, literals, registered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import literals, normalize_for_match


def excerpt_holds(verbatim: Column, excerpt: Column) -> Column:
    """A non-empty excerpt is part of the text, both folded and collapsed."""
    e = normalize_for_match(F.coalesce(excerpt, F.lit("")))
    return (F.length(e) > 0) & F.contains(normalize_for_match(F.coalesce(verbatim, F.lit(""))), e)


def verify_claims(claims: DataFrame, units: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """claims (claim_id, afirmacao, supports array<struct<evidence_id,
    trecho_base>>, doc_ids array<string>) to (claim_id, status, n_supports,
    n_ok, missing_literals, missing_docs).

    A support whose unit is missing or whose excerpt isn't in it fails the
    claim; the last failing one gives the status.  Literals of the claim are
    looked for in the joined excerpts only if all supports hold, documents
    last.  Each unit's text is joined once per support; a claim without
    supports is ``evidencia_inexistente``.
    """
    s = claims.select("claim_id", F.posexplode_outer("supports").alias("pos", "s")).filter(F.col("s").isNotNull()).select("claim_id", "pos", "s.evidence_id", "s.trecho_base")
    u = units.select("evidence_id", F.col("text").alias("_text"), F.lit(True).alias("_known")).dropDuplicates(["evidence_id"])
    j = s.join(u, "evidence_id", "left")
    ok = F.coalesce(F.col("_known"), F.lit(False)) & excerpt_holds(F.col("_text"), F.col("trecho_base"))
    j = j.select("claim_id", "pos", ok.alias("ok"), F.when(F.col("_known").isNull(), "evidencia_inexistente").otherwise("trecho_nao_encontrado").alias("why"), normalize_for_match(F.coalesce("trecho_base", F.lit(""))).alias("e"))
    per = j.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_supports"),
        F.count_if("ok").alias("n_ok"),
        F.max_by("why", F.when(~F.col("ok"), F.col("pos"))).alias("failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "e")))), lambda x: x["e"]), " ").alias("ground"),
    )
    c = claims.select("claim_id", "afirmacao", "doc_ids").join(per, "claim_id", "left")
    missing = F.filter(literals(F.coalesce("afirmacao", F.lit(""))), lambda x: ~F.contains(F.coalesce(F.col("ground"), F.lit("")), normalize_for_match(x)))
    c = c.withColumn("missing_literals", missing)
    d = c.select("claim_id", F.explode("doc_ids").alias("doc_id")).distinct()
    if registered is not None:
        d = d.join(registered.select("doc_id").distinct(), "doc_id", "left_anti")
    d = d.groupBy("claim_id").agg(F.array_sort(F.collect_list("doc_id")).alias("missing_docs"))
    c = c.join(d, "claim_id", "left").withColumn("missing_docs", F.coalesce("missing_docs", F.array().cast("array<string>")))
    all_ok = F.col("failed").isNull()
    status = (
        F.when(F.coalesce("n_supports", F.lit(0)) == 0, "evidencia_inexistente")
        .when(~all_ok, F.col("failed"))
        .when(F.size("missing_literals") > 0, "literal_nao_suportado")
        .when(F.size("missing_docs") > 0, "doc_id_nao_registrado")
        .otherwise("ok")
    )
    return c.select("claim_id", status.alias("status"), F.coalesce("n_supports", F.lit(0)).alias("n_supports"), F.coalesce("n_ok", F.lit(0)).alias("n_ok"), "missing_literals", "missing_docs")


def missing_ids(asked: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct asked ids that aren't known."""
    return asked.select(column).filter(F.col(column).isNotNull()).distinct().join(known.select(column), column, "left_anti")


def reference_outcomes(evidence_ids: DataFrame, doc_ids: DataFrame, claims: DataFrame | None, units: DataFrame, registered: DataFrame) -> DataFrame:
    """(kind, id): a row for each evidence id or doc id that isn't known and each
    claim that fails; kind is evidence, doc or claim."""
    out = missing_ids(evidence_ids, units, "evidence_id").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))
    out = out.unionByName(missing_ids(doc_ids, registered, "doc_id").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")))
    if claims is not None:
        out = out.unionByName(verify_claims(claims, units, registered).filter("status <> 'ok'").select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id")))
    return out


def reference_verdict(outcomes: DataFrame) -> DataFrame:
    """One row: ok, and how many of each kind are missing or fail."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return outcomes.agg((F.count(F.lit(1)) == 0).alias("ok"), of("evidence").alias("missing_evidence"), of("doc").alias("missing_docs"), of("claim").alias("failed_claims"))


def verify_references(evidence_ids: DataFrame, doc_ids: DataFrame, claims: DataFrame | None, units: DataFrame, registered: DataFrame) -> DataFrame:
    """One row with lists: ok, missing_evidence_ids, missing_doc_ids,
    failed_claims.  For what one caller has asked; ``reference_outcomes`` is the
    form for any number."""
    o = reference_outcomes(evidence_ids, doc_ids, claims, units, registered)
    ids = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id"))))
    return o.agg((F.count(F.lit(1)) == 0).alias("ok"), ids("evidence").alias("missing_evidence_ids"), ids("doc").alias("missing_doc_ids"), ids("claim").alias("failed_claims"))
