"""The driver's queries on its tables, each a thin use of the operators.

Stand-ins: a document is an evidence unit, its source a case; conversations
are stamped files; order lines are ledger rows; events are raw events; the
benchmark is a list of claims.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import identity as ident
from evidentia.functions import text as tx
from evidentia.operators import coverage as cov
from evidentia.operators import docmap as dm
from evidentia.operators import events as ev
from evidentia.operators import matrix as mx
from evidentia.operators import search as se
from evidentia.operators import verify as vf
from evidentia.plans.sql import SEARCHES, TOPICS
from evidentia.rules import RulePack
from evidentia.sources import store as st
from evidentia.sources.pages import html_pages
from evidentia.sources.shared import shared_folder, spread
from evidentia.sources.tables import find_deadlines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Tables of texts, which are worth spreading over all cores.
TEXTS = ("documents", "pages", "conversations")
#: A pack for the synthetic prose: its commonest words stand for pieces.
GENERIC = RulePack(
    pieces=(("license", r"\blicen[sc]e"), ("german", r"\b(und|der)\b"), ("french", r"\b(les|est)\b"), ("spanish", r"\b(los|una)\b"), ("english", r"\b(the|and)\b")),
    events=(("purchase", r"\bpurchase\b"),),
    modes=(),
    critical=("inicial", "contestacao", "sentenca"),
    concepts=("the", "of", "licensed", "und"),
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEARCHES), "query_id string, query string")


# ---------------------------------------------------------------- search


@query
def bm25_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    out = se.bm25(searches(spark), t(spark, d, "documents"), 10)
    return out.select("query_id", "doc_id", "mode", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    out = se.bm25(searches(spark), t(spark, d, "documents"), 25).filter("mode = 'and'")
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return se.term_stats(t(spark, d, "documents"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    # the stated query set: every vector whose id is divisible by 50
    return t(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    out = se.vector_topk(_vector_queries(spark, d), t(spark, d, "embeddings"), 10)
    return out.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, d, "documents")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    # the query's vector is that of the document with the query's number
    q = searches(spark).withColumn("n", F.regexp_extract("query_id", r"(\d+)", 1).cast("long"))
    qv = q.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("qvec")), "n").select("query_id", "qvec")
    return se.bm25(searches(spark), docs, 10), se.vector_topk(qv, vectors, 10, "doc_id")


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = se.rrf(*_both(spark, d), 10)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("semantic_rank").cast("long").alias("semantic_rank"))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    q = searches(spark).withColumn("n", F.regexp_extract("query_id", r"(\d+)", 1).cast("long"))
    e = t(spark, d, "embeddings")
    q = q.join(e.select(F.col("vec_id").alias("n"), F.col("embedding").alias("qvec")), "n", "left").drop("n")
    out = se.hybrid(q, t(spark, d, "documents"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 10)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "mode", "excerpt")


@query
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return se.missing_vectors(t(spark, d, "documents"), t(spark, d, "embeddings")).select("doc_id", "source")


@query
def snippet_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, q = t(spark, d, "documents"), searches(spark)
    return se.snippets(se.bm25(q, docs, 5).select("query_id", "doc_id", "rank"), q, docs, k=5)


@query
def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents indexed by source in three writes, a third of them twice, then
    searched over the stored postings and statistics."""
    from evidentia.streaming.ingest import index_units

    store = st.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    docs = t(spark, d, "documents").filter("source IS NOT NULL").select(F.col("doc_id").cast("string").alias("evidence_id"), F.col("source").alias("case_id"), "text", "doc_id")
    for part in (docs.filter("doc_id % 3 < 2").withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.upper("text")).otherwise(F.lit("old words"))), docs.filter("doc_id % 3 = 2"), docs.filter("doc_id % 3 = 0")):
        index_units(store, part)
    index = store.read("postings")
    q = docs.select("case_id").distinct().select("case_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SEARCHES))).alias("s"))
    q = q.select("case_id", F.concat_ws("/", "case_id", "s.a").alias("query_id"), F.col("s.b").alias("query"))
    out = se.bm25(q, None, 3, "evidence_id", group=("case_id",), index=index, stats=se.index_stats(index, ["case_id"]))
    return out.select("query_id", F.col("evidence_id").cast("long").alias("doc_id"), "mode", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- text


@query
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", tx.text_quality("text").alias("q"))
    return x.select("doc_id", F.col("q.score").alias("score"), F.col("q.needs_enrichment").alias("needs_ocr"), F.array_join("q.reasons", ",").alias("reasons"))


@query
def quality_confusion(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", tx.text_quality("text")["needs_enrichment"].alias("p")).join(t(spark, d, "labels"), "doc_id")
    a = F.col("quality") == 0
    return x.agg(F.count_if(F.col("p") & a).alias("tp"), F.count_if(~F.col("p") & ~a).alias("tn"), F.count_if(F.col("p") & ~a).alias("fp"), F.count_if(~F.col("p") & a).alias("fn"))


@query
def ocr_yield(spark: SparkSession, d: str) -> DataFrame:
    stamped = F.concat("text", F.lit(" Num. "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " - Pág. 3 https://pje.example/x?y Fls. 12").otherwise(" - Pág. 3 HTTPS://PJE.example/x?y Fls. 12"))
    x = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(stamped).alias("s"))
    y = tx.page_yield("s")
    return x.select("doc_id", y["yield"].alias("ocr_yield"), y["useful"].cast("long").alias("useful"))


@query
def pii_strip(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", tx.strip_personal("text", ["Licensed under"]).alias("s"))
    return x.select("doc_id", F.md5("s").alias("stripped_md5"), F.regexp_count("s", F.lit(r"\[(cpf|cnpj|email|processo)\]")).cast("long").alias("masks"))


@query
def secret_redact(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.col("text"), F.lit(" https://x.example/a?key=abc"), F.col("doc_id").cast("string"), F.lit("&z=1 AIzaSyA0123456789_abcdefghijk s3cretvalue"))
    return t(spark, d, "documents").select("doc_id", F.md5(tx.redact_secrets(s, ["s3cretvalue", "short"])).alias("redacted_md5"))


@query
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(tx.normalize_for_match("text")).alias("folded_md5"), F.size(tx.tokens("text")).cast("long").alias("n_tokens"))


@query
def literal_extract(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    s = F.concat(F.lit("Em "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(") pagou R$ "), F.replace(F.format_string("%.2f", F.col("o_totalprice")), F.lit("."), F.lit(",")), F.lit(" com "), (F.col("o_orderkey") % 90).cast("string"), F.lit(",5% de multa"))
    return o.select("o_orderkey", F.array_join(tx.literals(s), "|").alias("literals"), F.array_join(tx.dates(s), "|").alias("dates"))


@query
def dense_excerpts(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("Num. 123 - Pág. 4 "), F.col("text"))
    return t(spark, d, "documents").select("doc_id", tx.dense_excerpt(s).alias("excerpt"))


@query
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", ev.classify(F.col("text"), ~tx.text_quality("text")["needs_enrichment"], pack=GENERIC).alias("c"))
    return x.select("doc_id", F.col("c.piece_type").alias("piece_type"), F.col("c.confidence").alias("confidence"))


#: What stands at the head of a court page, one of each kind.
COURT_HEADS = (
    "PETIÇÃO INICIAL do autor", "Réplica ao réu", "IMPUGNAÇÃO À CONTESTAÇÃO", "CONTESTAÇÃO do banco", "Sentença de mérito", "DESPACHO do juiz", "AGRAVO de instrumento", "Recibo e PIX", "PROCURAÇÃO ad judicia",
    "cópia do RG e CPF", "DENÚNCIA do Ministério Público", "Resposta à acusação", "Memoriais da defesa", "LAUDO PERICIAL contábil", "folha sem título", "Decisão e sentença",
)


def court_text(texts: tuple[str, ...]) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int")), F.lit(". "), F.coalesce("text", F.lit("")))


@query
def classify_court_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents under the heads of court pages, by the pack for court files; a
    fifth follows a page whose type goes on."""
    before = F.when(F.col("doc_id") % 5 == 0, "sentenca")
    c = ev.classify(court_text(COURT_HEADS), ~tx.text_quality("text")["needs_enrichment"], F.when(F.col("doc_id") % 7 == 0, "Anexo"), before)
    x = t(spark, d, "documents").select("doc_id", c.alias("c"))
    return x.select("doc_id", F.col("c.piece_type").alias("piece_type"), F.col("c.confidence").alias("confidence"), F.col("c.signal").alias("signal"), ev.is_critical(F.col("c.piece_type"), F.col("c.confidence") < 0.2).alias("critical"))


COURT_TERMS = ("cobrança e Prescrição do pagamento", "DANO MORAL com juros de mora", "tutela de urgência e repetição de indébito", "nada a registrar", "Negativação do consumidor, honorários", "rescisão por inadimplemento, indenização")


@query
def court_concepts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.array_join(ev.concepts(court_text(COURT_TERMS)), ",").alias("concepts"))


@query
def legal_concepts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.array_join(ev.concepts(F.col("text"), GENERIC), ",").alias("concepts"))


@query
def case_slugs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", tx.case_slug("url").alias("slug"))


@query
def html_page_source(spark: SparkSession, d: str) -> DataFrame:
    p = html_pages(t(spark, d, "pages"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1), F.col("page_id"))
    return p.select(F.col("page").alias("page_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "needs_enrichment")


# ---------------------------------------------------------------- document map


def stamped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as files: ten cases, stamped by pje, eproc or e-STJ."""
    k = F.col("conv_id") % 10
    doc, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    pje = F.concat(F.lit("Num. "), doc, F.lit(" - Pág. "), turn, F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" Assinado eletronicamente por: "), F.col("role"), F.lit(" - 0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("/05/2024"))).otherwise(F.lit("")))
    eproc = F.concat(F.lit("Evento "), (F.col("conv_id") % 1000).cast("string"), F.lit(" PET1 / Página "), turn)
    stj = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("(e-STJ Fl."), (F.col("conv_id") * 10 + F.col("turn")).cast("string"), F.lit(")"))).otherwise(F.lit("sem carimbo"))
    text = F.when(k <= 5, pje).when(k <= 7, eproc).when(k == 8, stj).otherwise(F.lit("conforme evento 12 da lista"))
    c = t(spark, d, "conversations")
    return dm.parse_stamps(c.select(k.cast("string").alias("case_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("page"), text.alias("text"), "conv_id"))


PIECES = ("inicial", "contestacao", "comprovante", "sentenca", "unknown")


def piece_of(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PIECES)), (n % len(PIECES) + 1).cast("int"))


def conversation_map(spark: SparkSession, d: str) -> DataFrame:
    s = stamped_pages(spark, d)
    return dm.document_map(s, s.select("case_id", "page", piece_of(F.col("conv_id")).alias("piece_type")))


@query
def source_system_detect(spark: SparkSession, d: str) -> DataFrame:
    return dm.source_system(stamped_pages(spark, d))


@query
def document_map(spark: SparkSession, d: str) -> DataFrame:
    return conversation_map(spark, d).select("case_id", "sistema", "num", "first_page", "last_page", "pages", "signed_date", "signer", "piece_type", "citacao")


@query
def page_to_document(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as pages, part ranges as documents that overlap."""
    o = t(spark, d, "orders")
    docs = o.select((F.col("o_custkey") % 20).alias("case_id"), F.col("o_orderkey").cast("string").alias("num"), (F.col("o_orderkey") % 5000).alias("first_page"), (F.col("o_orderkey") % 5000 + F.col("o_custkey") % 7).alias("last_page"))
    pages = t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("case_id"), (F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("page"), "l_orderkey", "l_linenumber")
    return dm.page_to_document(pages, docs, carry=("num", "first_page", "last_page"))


@query
def page_citation(spark: SparkSession, d: str) -> DataFrame:
    s = stamped_pages(spark, d)
    return dm.page_citations(s.select("case_id", "page").distinct(), conversation_map(spark, d), s)


@query
def group_remainder(spark: SparkSession, d: str) -> DataFrame:
    g = dm.remainder_groups(conversation_map(spark, d), 4)
    return g.select("case_id", "tipo", "count", "total_paginas", "intervalo", F.array_join(F.transform("exemplos", lambda e: e["citacao"]), "|").alias("exemplos"))


@query
def case_page_window(spark: SparkSession, d: str) -> DataFrame:
    w = dm.page_of_documents(conversation_map(spark, d), 5, 2)
    return w.select("case_id", "num", F.col("position").cast("long").alias("position"), F.col("total").cast("long").alias("total"), "has_more")


@query
def panel_counts(spark: SparkSession, d: str) -> DataFrame:
    return cov.piece_counts(conversation_map(spark, d)).select("case_id", "piece_type", "n", F.col("position").cast("long").alias("position"))


# ---------------------------------------------------------------- events


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    case = (F.col("user_id") % 50).cast("string")
    return e.select(
        case.alias("case_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("raw_event_id"), F.col("event_type").alias("tipo"), F.lit(None).cast("string").alias("subtipo"),
        F.when(F.col("value") > 50, "alto").alias("modalidade"), F.date_format("ts", "yyyy-MM-dd").alias("data_documento"), F.lit(None).cast("string").alias("data_juntada"), F.lit("texto_do_documento").alias("fonte_data"),
        F.concat(F.lit("evento "), F.col("event_type")).alias("descricao"), F.array(ident.evidence_id(case, F.col("event_id") % 40 + 1, F.lit("p001"))).alias("evidence_ids"),
        F.when(F.col("event_id") % 4 == 0, 0.75).otherwise(0.95).alias("reading_confidence"), F.lit(0.8).alias("extraction_confidence"),
    )


@query
def event_reconcile(spark: SparkSession, d: str) -> DataFrame:
    r = ev.reconcile(raw_events(spark, d))
    return r.select("case_id", "event_id", "tipo", "modalidade", "data_documento", "descricao", "canonical_evidence_id", F.size("evidence_ids").cast("long").alias("n_evidence"), F.array_join("evidence_ids", ",").alias("evidence_ids"), "reading_confidence", "status")


@query
def event_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    r = ev.reconcile(raw_events(spark, d))
    return r.groupBy("case_id", "tipo").agg(F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count(F.lit(1)).alias("n"))


@query
def event_extract(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of court files."""
    o = t(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("Mandado de CITAÇÃO por oficial de justiça", "Sentença no Diário", "nota", "Contestação juntada"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(kind, F.lit(" em "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(", juntado em "), F.date_format(F.date_add("o_orderdate", 5), "dd/MM/yyyy"))).otherwise(F.lit("")))
    case = (F.col("o_custkey") % 100).cast("string")
    u = o.select(case.alias("case_id"), F.col("o_orderkey").alias("page"), F.lit("p001").alias("unit_id"), F.lit("page_text").alias("unit_type"), ident.evidence_id(case, F.col("o_orderkey"), F.lit("p001")).alias("evidence_id"), text.alias("text"))
    e = ev.extract_events(u)
    return e.select("case_id", "raw_event_id", "tipo", "subtipo", "modalidade", "data_documento", "data_juntada", F.col("evidence_ids")[0].alias("evidence_id"), "reading_confidence")


@query
def timeline_union(spark: SparkSession, d: str) -> DataFrame:
    e = ev.reconcile(raw_events(spark, d))
    o = t(spark, d, "orders")
    docs = o.select(
        (F.col("o_custkey") % 50).cast("string").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("signed_date"), F.col("o_orderpriority").alias("piece_type"), F.col("o_orderkey").cast("string").alias("num"),
        F.lit(None).cast("string").alias("evento"), F.lit(None).cast("string").alias("signer"), F.concat(F.lit("ID "), F.col("o_orderkey").cast("string")).alias("citacao"), F.col("o_orderkey").alias("first_page"), F.col("o_orderkey").alias("last_page"), F.lit(1).alias("pages"),
    )
    x = ev.timeline(e, docs, "1995-01-01", "2024-06-30")
    return x.groupBy("case_id", "data", "origem", "tipo").agg(F.count(F.lit(1)).alias("n"), F.min("position").cast("long").alias("first_position"), F.max("ref").alias("last_ref"))


@query
def procedural_radar(spark: SparkSession, d: str) -> DataFrame:
    r = ev.radar(ev.reconcile(raw_events(spark, d)), "autor", trigger="purchase")
    return r.select("case_id", "lista", "radar_id", "evento_base", "tipo", "reading_confidence", "extraction_confidence")


@query
def phase_detect(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    piece = F.element_at(F.array(*map(F.lit, ("inicial", "contestacao", "replica", "sentenca", "recurso"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    led = o.select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("page"), piece.alias("piece_type"))
    return ev.phase(led).select("case_id", "fase_id", "ancora", "ancora_primeira", "ancora_ultima", "confianca")


@query
def header_facts_argmax(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("papel"), F.round(F.col("o_totalprice") / 100000, 1).alias("confianca"), F.col("o_orderkey").alias("page"))
    return ev.argmax_candidates(c, ["case_id", "papel"], "confianca", ["page"])


@query
def header_parties(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    text = F.concat(F.lit("AUTOR: "), F.col("c_name"), F.lit(", em face de Empresa "), F.col("c_mktsegment"), F.lit(". Valor da causa: R$ 1.234,"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    case = F.col("c_custkey").cast("string")
    u = c.select(case.alias("case_id"), F.lit(1).alias("page"), F.lit("p001").alias("unit_id"), F.lit("page_text").alias("unit_type"), ident.evidence_id(case, F.lit(1), F.lit("p001")).alias("evidence_id"), text.alias("text"))
    return ev.header_facts(u)


# ---------------------------------------------------------------- coverage


def order_ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as cases of seven pages, their lines as ledger rows."""
    cases = t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(7).alias("total_pages"))
    state = F.when(F.col("l_returnflag") == "R", "ocr_needed").when(F.col("l_returnflag") == "A", "done").when(F.col("l_linestatus") == "O", "ocr_done").otherwise("failed_retryable")
    led = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("page"), state.alias("state"), piece_of(F.col("l_linenumber") - 1).alias("piece_type"),
        F.when(F.col("l_quantity") < 5, 0).otherwise(F.col("l_quantity").cast("int")).alias("native_text_chars"), F.when(F.col("l_discount") == 0, "stamp_only").otherwise("content").alias("ocr_yield"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("page_hash"),
    )
    return cases, led


@query
def coverage_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = cov.coverage_manifest(*order_ledger(spark, d))
    lists = ("pages_ocr_needed", "pages_ocr_done", "pages_failed_retryable", "pages_ocr_stamp_only", "pages_unknown_unread")
    return m.select("case_id", "pages_read", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in lists), "n_gaps", "never_extracted", "global_analysis_allowed")


@query
def never_extracted(spark: SparkSession, d: str) -> DataFrame:
    return cov.never_extracted(*order_ledger(spark, d))


@query
def critical_gaps_by_type(spark: SparkSession, d: str) -> DataFrame:
    g = cov.gaps(*order_ledger(spark, d))
    return g.select("case_id", "kind", "piece_type", "n_pages", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def event_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "error", "done", "paused_awaiting_ocr_approval"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t(spark, d, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("event_id") % 13).cast("int").alias("total_pages"), F.col("ts").alias("last_heartbeat_at"), F.lit(30000).cast("long").alias("heartbeat_deadline_ms"),
    )


@query
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return cov.latest_job(event_jobs(spark, d)).select("case_id", "job_id", "status", "total_pages")


@query
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    _, led = order_ledger(spark, d)
    s = cov.status_view(cov.status_summary(event_jobs(spark, d), led), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return s.select("case_id", "status", "total_pages", "processed", F.col("n_needs_ocr").cast("long").alias("n_needs_ocr"), "proxima_acao", "custo_estimado", "execucao")


@query
def ocr_estimates(spark: SparkSession, d: str) -> DataFrame:
    _, led = order_ledger(spark, d)
    e = cov.ocr_estimate(led, None, 2)
    return e.select("case_id", "pending", "requires_approval", "may_run")


@query
def resume_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose ledger row isn't settled with the same hash."""
    _, led = order_ledger(spark, d)
    pages = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("page"), F.sha2((F.col("l_partkey") + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)).cast("string"), 256).alias("hash"))
    return cov.skip_extracted(pages, led).select("case_id", "page")


# ---------------------------------------------------------------- matrix and verification


@query
def topic_matrix(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame(list(TOPICS), "topic string, query_idx int, query string").withColumn("query_id", F.concat_ws("#", "topic", F.col("query_idx").cast("string")))
    docs = t(spark, d, "documents")
    hits = se.bm25(q.select("query_id", "query"), docs, 24).join(q.select("query_id", "topic", "query_idx"), "query_id")
    role = F.create_map(*[F.lit(x) for x in ("en", "inicial", "de", "contestacao", "fr", "atos_judiciais")])
    m = mx.topic_matrix(hits.select("topic", "query_idx", "rank", "doc_id"), docs.select("doc_id", role[F.col("lang")].alias("role")), 4, True, "doc_id")
    return m.select("topic", "role", F.col("position").cast("long").alias("position"), "doc_id", "source_kind")


def claims_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as claims on documents of the whole id range: the whole
    passage, or in every other item the document's own whole text with wider spaces."""
    docs, n = t(spark, d, "documents"), F.col("n")
    size = docs.agg((F.max("doc_id") + 1).alias("n"))  # one row
    b = t(spark, d, "benchmark").join(F.broadcast(size)).withColumn("e", F.when(F.col("item_id") % 10 == 0, n + F.col("item_id")).otherwise(F.col("item_id") * 7919 % n))
    b = b.join(docs.select(F.col("doc_id").alias("e"), F.replace("text", F.lit(" "), F.lit("  ")).alias("own")), "e", "left")
    return b.select(
        F.col("item_id").cast("string").alias("claim_id"), F.concat(F.lit("item "), F.when(F.col("item_id") % 3 == 0, "12%").otherwise("")).alias("afirmacao"),
        F.array(F.struct(F.col("e").cast("string").alias("evidence_id"), F.when(F.col("item_id") % 2 == 1, F.col("own")).otherwise(F.col("text")).alias("trecho_base"))).alias("supports"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("d0"), F.concat(F.lit("d"), (F.col("item_id") % 4).cast("string")))).alias("doc_ids"),
    )


@query
def claims_verify(spark: SparkSession, d: str) -> DataFrame:
    """Whole passages and whole texts looked for in the documents they name."""
    claims = claims_of_items(spark, d)
    units = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), "text")
    reg = spark.createDataFrame([("d0",), ("d1",)], "doc_id string")
    v = vf.verify_claims(claims, units, reg)
    return v.select("claim_id", "status", F.col("n_supports").cast("long").alias("n_supports"), F.col("n_ok").cast("long").alias("n_ok"), F.array_join("missing_literals", "|").alias("missing_literals"), F.array_join("missing_docs", "|").alias("missing_docs"))


@query
def reference_missing_ids(spark: SparkSession, d: str) -> DataFrame:
    asked = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return vf.missing_ids(asked, t(spark, d, "labels"), "doc_id")


# ---------------------------------------------------------------- stores and tables


@query
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    new = docs.filter("doc_id % 3 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 1_000_000).otherwise(0)).alias("doc_id"), F.lit("new").alias("source"), (F.col("n_chars") * 2).alias("n_chars"))
    return st.upsert(docs, new, ["doc_id"])


@query
def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    return st.delete(t(spark, d, "embeddings").select("vec_id", "label"), t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id")), ["vec_id"])


@query
def job_patch(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    ch = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 8 == 0, "9-NEW").alias("o_orderpriority"))
    return st.patch(o, ch, ["o_orderkey"])


@query
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    new = p.filter("p_partkey % 5 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 5_000_000).otherwise(0)).alias("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "renamed").alias("p_name"), F.lit("B#0").alias("p_brand"))
    return st.merge_registry(p, new, ["p_partkey"])


@query
def dossier_append(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    units = docs.select(F.col("doc_id").cast("string").alias("evidence_id"))
    b = t(spark, d, "benchmark").join(F.broadcast(docs.agg((F.max("doc_id") + 1).alias("n"))))  # one row
    new = b.select((F.col("item_id") % 3).cast("string").alias("case_id"), F.col("text").alias("achado"), F.array((F.col("item_id") * 7919 % (F.col("n") * 2)).cast("string"), F.lit("1")).alias("evidence_ids"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "case_id string, achado_id string, achado string, evidence_ids array<string>, registrado_em timestamp")
    out = st.append_findings(st.append_findings(empty, new.limit(0), units, now), new, units, now)
    return out.select("case_id", "achado_id", F.length("achado").cast("long").alias("n_chars"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query
def deadline_lookup(spark: SparkSession, d: str) -> DataFrame:
    return find_deadlines(t(spark, d, "part"), "ECÓNOMY", ("p_type", "p_name")).select("p_partkey", "p_type")


@query
def stream_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream, read to its end."""
    from evidentia.streaming.ingest import event_counts

    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = t(spark, d, "events").schema
    return event_counts(spark, f"{d}/event[s].parquet", f"{run}/checkpoint", f"{run}/out", schema)


from evidentia.plans import case_queries, engine_queries  # noqa: E402, F401 - add their queries
