"""Topic by role matrix and evidence bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.functions.text import bound, fold, strip_personal_names
from evidentia.operators.events import concepts
from evidentia.operators.running import numbered
from evidentia.rules import PT_LEGAL, RulePack

SOURCE_KIND = {"inicial": "alegacao_autor", "contestacao": "alegacao_reu", "replica": "replica_autor", "atos_judiciais": "ato_judicial"}
OUTSIDE = "fontes_primarias"


def role_of(piece: Column, pack: RulePack = PT_LEGAL) -> Column:
    names = F.create_map(*[F.lit(x) for kv in pack.roles.items() for x in kv])
    return F.coalesce(names[piece], F.lit(OUTSIDE))


def topic_matrix(hits: DataFrame, roles: DataFrame, limit: int = 4, primary: bool = True, id_col: str = "evidence_id") -> DataFrame:
    """hits (topic, query_idx, rank, id) by role: (topic, role, position, id,
    source_kind), at most ``limit`` per topic and role.

    A unit that several queries of a topic find counts where it was found
    first.  roles (id, role); a unit without one is a primary source.
    """
    limit = min(max(1, limit), 10)
    x = hits.groupBy("topic", id_col).agg(F.min(F.struct("query_idx", "rank")).alias("at"))
    x = x.join(roles.select(id_col, "role"), id_col, "left").withColumn("role", F.coalesce("role", F.lit(OUTSIDE)))
    if not primary:
        x = x.filter(F.col("role") != OUTSIDE)
    x = x.withColumn("position", F.row_number().over(W.partitionBy("topic", "role").orderBy("at", id_col))).filter(F.col("position") <= limit)
    kind = F.create_map(*[F.lit(v) for kv in SOURCE_KIND.items() for v in kv])
    return x.select("topic", "role", "position", id_col, F.coalesce(kind[F.col("role")], F.lit("prova_primaria")).alias("source_kind"))


def matrix_gaps(matrix: DataFrame, topics: DataFrame, present: DataFrame) -> DataFrame:
    """(topic, gap): roles the case has whose cell is empty, and the defence
    if the case has none.  topics (topic); present (role)."""
    filled = matrix.select("topic", "role").distinct()
    roles = present.filter(F.col("role").isin("inicial", "contestacao")).select("role").distinct()
    cells = topics.withColumn("_one", F.lit(1)).join(F.broadcast(roles.withColumn("_one", F.lit(1))), "_one").drop("_one")  # at most two roles
    empty = cells.join(filled, ["topic", "role"], "left_anti")
    say = F.when(F.col("role") == "inicial", "Sem ocorrência do tema na petição inicial.").otherwise("Sem ocorrência do tema na contestação — candidato a fato sem impugnação específica (confirme lendo a peça).")
    has = present.agg(F.max((F.col("role") == "contestacao").cast("int")).alias("has")).withColumn("_one", F.lit(1))
    none = topics.withColumn("_one", F.lit(1)).join(F.broadcast(has), "_one").filter(F.coalesce("has", F.lit(0)) == 0)
    return empty.select("topic", say.alias("gap")).unionByName(none.select("topic", F.lit("Contestação não identificada no caderno.").alias("gap")))


#: Searches tried in turn when the objective finds nothing.
FALLBACKS = ("autor pagamento dano prescricao contestacao", "pagamento", "dano", "prescricao", "contestacao")


def first_with_hits(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Of each ``key`` the hits of the first alternative (``alt``) that has any."""
    first = hits.groupBy(key).agg(F.min("alt").alias("alt"))
    return hits.join(first, [key, "alt"])


def bundle_query(objective: Column, texts: Column, names: Column, pack: RulePack = PT_LEGAL, most: int = 300) -> Column:
    """A search text for outside: objective and the concepts of the facts that
    it lacks, without personal data."""
    found = bound(fold(objective), lambda f: F.filter(concepts(texts, pack), lambda c: ~F.contains(f, c)))
    return F.substring(strip_personal_names(F.concat_ws(" ", objective, F.array_join(found, " ")), names), 1, most)


def first_seen(rows: DataFrame, keys: list[str], value: str, place: Column) -> DataFrame:
    """(keys..., values): the distinct values of each key in the order of their
    first places.  Values are combined before they are gathered."""
    seen = rows.groupBy(*keys, value).agg(F.min(place).alias("_at"))
    return seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_s")).select(*keys, F.transform("_s", lambda x: x[value]).alias(value))


def role_pieces(documents: DataFrame, pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """(case, role, position, num, paginas, citacao): the documents that stand
    for a role, in the order of their pages; those of no role are left out."""
    d = documents.select(case, role_of(F.col("piece_type"), pack).alias("role"), "num", "first_page", "last_page", "citacao").filter(F.col("role") != OUTSIDE)
    d = numbered(d.withColumn("_b", F.coalesce(F.floor(F.col("first_page") / 1024), F.lit(-1))), [case, "role"], ["_b"], ["first_page", "num"], "position")
    return d.select(case, "role", "position", "num", F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string")).alias("paginas"), "citacao")


def proof_pages(ledger: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, page, evidence_id, display_ref): every page that is a proof."""
    ref = F.concat(F.lit("pagina "), F.col("page").cast("string"))
    return ledger.filter("piece_type = 'comprovante'").select(case, "page", F.try_element_at("evidence_ids", F.lit(1)).alias("evidence_id"), ref.alias("display_ref"))


#: Proof pages that a bundle shows; ``proof_pages`` has all of them.
MOST_PROOFS = 1000


def bundles(objectives: DataFrame, facts: DataFrame, ledger: DataFrame, radar: DataFrame, coverage: DataFrame, names: DataFrame, pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """One bundle per objective (case, objetivo, lado): facts (case, rank,
    evidence_id, trecho), proofs (the first ``MOST_PROOFS`` pages, and their
    number), theses in the order in which the radar has them, gaps and the
    outside query."""
    clean = F.replace(F.replace(F.coalesce("trecho", F.lit("")), F.lit("«")), F.lit("»"))
    f = facts.select(case, "rank", "evidence_id", clean.alias("t"))
    f = f.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", F.substring("t", 1, 240).alias("texto"), F.substring("t", 1, 500).alias("trecho")))).alias("fatos"))
    every = proof_pages(ledger, case)
    first = every.withColumn("_r", F.row_number().over(W.partitionBy(case).orderBy("page", "evidence_id"))).filter(F.col("_r") <= MOST_PROOFS)
    p = first.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("page", "evidence_id"))).alias("provas")).join(every.groupBy(case).agg(F.count(F.lit(1)).alias("n_provas")), case)
    t = first_seen(radar, [case], "hipotese", F.struct(F.when(F.col("lista") == "prazo", 0).otherwise(1), "radar_id")).withColumnRenamed("hipotese", "teses")
    out = objectives
    for x in (f, p, t, coverage.select(case, F.col("critical_gaps").alias("lacunas")), names):
        out = out.join(x, case, "left")
    joined = F.array_join(F.transform(F.coalesce("fatos", F.array().cast(f.schema["fatos"].dataType)), lambda s: s["trecho"]), " \n ")
    q = F.when(F.size("fatos") > 0, F.struct(bundle_query(F.col("objetivo"), joined, F.col("names"), pack).alias("query"), F.slice(F.transform("fatos", lambda s: s["evidence_id"]), 1, 10).alias("fundamento")))
    return out.withColumn("query_externa", q).drop("names")
