"""More of the driver's queries: cases, jobs, panels, bundles, registers."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import identity as ident
from evidentia.functions import text as tx
from evidentia.operators import coverage as cov
from evidentia.operators import docmap as dm
from evidentia.operators import events as ev
from evidentia.operators import matrix as mx
from evidentia.operators import search as se
from evidentia.operators import verify as vf
from evidentia.plans.queries import claims_of_items, event_jobs, header_parties, order_ledger, piece_of, query, raw_events, t
from evidentia.sources import store as st
from evidentia.sources.files import Files
from evidentia.sources.shared import shared_folder

NOW = "2024-06-01 00:00:00"
ORDER_PIECES = ("inicial", "contestacao", "replica", "sentenca", "recurso")


def order_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of their customer's case, the priority as piece type."""
    piece = F.element_at(F.array(*map(F.lit, ORDER_PIECES)), F.substring("o_orderpriority", 1, 1).cast("int"))
    return t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("page"), piece.alias("piece_type"))


def customer_cases(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.when(F.col("c_nationkey") % 2 == 0, "penal").otherwise("civil").alias("area"), (F.col("c_custkey") % 100 + 1).cast("int").alias("total_pages"), F.col("c_acctbal").alias("updated_at"))


@query
def ocr_estimates_approved(spark: SparkSession, d: str) -> DataFrame:
    """Approvals for two cases of three, without a page limit in every other."""
    _, led = order_ledger(spark, d)
    k = F.col("o_orderkey")
    a = t(spark, d, "orders").filter(k % 3 > 0).select(k.alias("case_id"), (k % 3 == 1).alias("approved"), F.when(k % 2 == 0, 10).alias("max_pages"), F.lit(40).alias("max_calls"))
    return cov.ocr_estimate(led, a, 1).select("case_id", "pending", "requires_approval", "approved", "max_pages", "max_calls", "may_run")


@query
def radar_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Radar with its reference row: parts stand for the deadline table."""
    p = t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("ato"), F.col("p_type").alias("prazo"), F.col("p_brand").alias("unidade"), F.lit(None).cast("string").alias("base_legal"), F.lit("ver").alias("observacoes"))
    r = ev.radar(ev.reconcile(raw_events(spark, d)), "reu", p, "purchase", "p7")
    return r.select("case_id", "lista", "radar_id", "lado_favorecido", F.size("ressalvas").cast("long").alias("n_ressalvas"), "prazo_referencia")


@query
def phase_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document that holds the phase's last anchor page."""
    o = t(spark, d, "orders")
    docs = o.select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").cast("string").alias("num"), (F.col("o_orderkey") - F.col("o_orderkey") % 100).alias("first_page"), F.col("o_orderkey").alias("last_page"), F.concat(F.lit("ID "), "o_orderkey").alias("citacao"))
    return ev.phase(order_pieces(spark, d), docs).select("case_id", "fase_id", "ancora_ultima", "ancora_citacao")


def order_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("citacao", "sentenca", "outra"))), (k % 3 + 1).cast("int"))
    return t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.concat(F.lit("evt-"), k).alias("event_id"), kind.alias("tipo"), F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("data_documento"), F.when(k % 2 == 0, F.lit("2024-01-02")).alias("data_juntada"), ident.evidence_id(F.col("o_custkey").cast("string"), k, F.lit("p001")).alias("canonical_evidence_id"))


@query
def case_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(header_parties(spark, d), order_pieces(spark, d), order_events(spark, d), customer_cases(spark, d))


@query
def case_listing(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    jobs = o.select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    found = o.filter("o_totalprice > 200000").select(F.col("o_custkey").cast("string").alias("case_id"))
    x = cov.case_listing(customer_cases(spark, d), header_parties(spark, d), jobs, found)
    return x.select("case_id", "area", "autor", "reu", "status", "achados")


@query
def case_panels(spark: SparkSession, d: str) -> DataFrame:
    """Panels of cases: counts per type and the first principal documents."""
    cases = t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(7).alias("total_pages"))
    _, led = order_ledger(spark, d)
    docs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("num"), F.col("l_linenumber").alias("first_page"), F.col("l_quantity").cast("int").alias("pages"), piece_of(F.col("l_linenumber") - 1).alias("piece_type"), F.concat(F.lit("ID "), "l_linenumber").alias("citacao"))
    facts = t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("reu").alias("papel"), F.col("o_orderpriority").alias("nome"))
    found = t(spark, d, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("case_id"))
    p = cov.case_panel(cases, facts, cov.coverage_manifest(cases, led), docs, found)
    show = lambda c, f: F.array_join(F.transform(c, f), "|")
    return p.select("case_id", "autor", "reu", "pages_read", F.col("n_ocr_needed").cast("long").alias("n_ocr_needed"), "n_gaps", show("pecas", lambda s: F.concat_ws(":", s["tipo"], s["n"].cast("string"))).alias("pecas"), "n_documentos", show("principais", lambda s: s["citacao"]).alias("principais"), "achados")


@query
def final_job_status(spark: SparkSession, d: str) -> DataFrame:
    cases, led = order_ledger(spark, d)
    cases = cases.select("case_id", (F.col("case_id") % 7 + 1).cast("int").alias("total_pages"), F.when(F.col("case_id") % 2 == 0, "penal").otherwise("civil").alias("area"))
    led = led.withColumn("piece_type", F.when(F.col("page") == 5, "denuncia").otherwise(F.col("piece_type")))
    f = cov.final_status(led, cases, cov.ocr_estimate(led, None, 2))
    return f.select("case_id", "final_status", F.array_join("alerts", ",").alias("alerts"))


@query
def references_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as evidence, labels as registered documents, items as claims."""
    units = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), "text")
    e = t(spark, d, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("evidence_id"))
    asked = t(spark, d, "events").select(F.concat(F.lit("d"), F.col("user_id") % 7).alias("doc_id"))
    reg = spark.createDataFrame([("d0",), ("d1",), ("d5",)], "doc_id string")
    o = vf.reference_outcomes(e, asked, claims_of_items(spark, d), units, reg)
    v = vf.reference_verdict(o).select(F.lit("verdict").alias("kind"), F.when(F.col("ok"), "ok").otherwise(F.concat_ws("/", "missing_evidence", "missing_docs", "failed_claims")).alias("id"))
    return o.unionByName(v)


@query
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by id and model: new ones beside, equal ones in place."""
    e = t(spark, d, "embeddings").select("vec_id", F.lit("a").alias("model"), "label")
    k = F.col("vec_id")
    new = t(spark, d, "embeddings").filter(k % 3 == 0).select("vec_id", F.when(k % 2 == 0, "a").otherwise("b").alias("model"), (F.col("label") + 100).alias("label"))
    return st.upsert(e, new, ["vec_id", "model"])


@query
def dossier_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as findings: long ones are cut, a case has 500 at most, and
    those that are there already stay."""
    docs = t(spark, d, "documents")
    units = docs.select(F.col("doc_id").cast("string").alias("evidence_id"))
    new = docs.select(F.lit("c").alias("case_id"), F.col("text").alias("achado"), F.array(F.col("doc_id").cast("string")).alias("evidence_ids"))
    now = F.lit(NOW).cast("timestamp")
    old = spark.createDataFrame([("c", f"old-{i}", "x", ["1"]) for i in range(30)], "case_id string, achado_id string, achado string, evidence_ids array<string>").withColumn("registrado_em", now)
    out = st.append_findings(old, new, units, now)
    return out.select("case_id", "achado_id", F.length("achado").cast("long").alias("n_chars"))


@query
def rejected_findings(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    units = docs.select(F.col("doc_id").cast("string").alias("evidence_id"))
    b = t(spark, d, "benchmark").join(F.broadcast(docs.agg((F.max("doc_id") + 1).alias("n"))))
    k = F.col("item_id")
    new = b.select((k % 3).cast("string").alias("case_id"), F.when(k % 7 == 0, "  ").otherwise(F.col("text")).alias("achado"), F.when(k % 5 > 0, F.array((k * 7919 % (F.col("n") * 2)).cast("string"), F.lit("zz"), F.lit("1"))).alias("evidence_ids"))
    return st.finding_errors(new, units).groupBy("case_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def display_refs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    return o.select(k, ident.display_ref(F.when(k % 5 == 0, F.lit(" ref ")).when(k % 5 == 1, F.lit("  ")), F.when(k % 3 > 0, F.col("o_orderpriority")), F.when(k % 2 == 0, F.concat(F.lit("fl. "), k)), k).alias("ref"))


@query
def visual_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose meaning is in the image, and that lack a vector."""
    _, led = order_ledger(spark, d)
    done = t(spark, d, "lineitem").filter("l_tax > 0.04").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("page"))
    return cov.visual_queue(led, done).select("case_id", "page")


@query
def textual_units(spark: SparkSession, d: str) -> DataFrame:
    """Units to embed by their text: not on visual pages, not yet done."""
    _, led = order_ledger(spark, d)
    units = led.select(F.concat_ws("-", "case_id", "page").alias("evidence_id"), "case_id", "page", F.when(F.col("native_text_chars") > 0, "texto").otherwise("").alias("text"))
    have = t(spark, d, "lineitem").filter("l_quantity > 45").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.when(F.col("l_linenumber") % 2 == 0, "m").otherwise("other").alias("model"))
    return cov.textual_queue(units, led, have, "m").select("evidence_id")


@query
def ledger_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Units that the ledger names, in its order, each once."""
    led = t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("case_id"), F.col("o_orderkey").alias("page"), F.array(F.concat(F.lit("u"), F.col("o_orderkey") % 700), F.concat(F.lit("u"), F.col("o_custkey"))).alias("evidence_ids"))
    units = t(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("evidence_id"), F.col("c_name").alias("text"))
    return cov.ledger_evidence(led, units).select("case_id", "position", "evidence_id", "text")


@query
def interrupted_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = event_jobs(spark, d).withColumn("case_id", F.concat(F.when(F.col("case_id") % 9 == 0, "_").otherwise(""), "case_id"))
    return cov.interrupted(jobs, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("case_id", "job_id", "status")


@query
def stamp_requeue(spark: SparkSession, d: str) -> DataFrame:
    _, led = order_ledger(spark, d)
    led = led.withColumn("ocr_prompt_version", (F.col("page") % 3).cast("int"))
    return cov.requeue_stamp_only(led, 2).select("case_id", "page", "state", "ocr_prompt_version")


@query
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each case and what they cost."""
    u = t(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"))
    return st.usage_totals(u).select("case_id", "tokens_in", "tokens_out")


@query
def pending_notes(spark: SparkSession, d: str) -> DataFrame:
    """Long lists of pages cut to their first ones, with a note."""
    p = t(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("case_id")).agg(F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")))).alias("p"))
    c = cov.compact_pages(F.col("p"))
    return p.select("case_id", F.array_join(c["pages"].cast("array<string>"), ",").alias("pages"), c["note"].alias("note"))


@query
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    """Of each user the hits of the first search that has any."""
    h = t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2).alias("alt"), "event_id")
    return mx.first_with_hits(h)


@query
def matrix_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Topics without an occurrence in a role that the case has."""
    topics = t(spark, d, "nation").select(F.col("n_name").alias("topic"))
    m = t(spark, d, "nation").select(F.col("n_name").alias("topic"), F.when(F.col("n_nationkey") % 3 == 0, "inicial").when(F.col("n_nationkey") % 3 == 1, "contestacao").otherwise("replica").alias("role"))
    out = mx.matrix_gaps(m, topics, m.select("role").distinct()).select(F.lit("all").alias("present"), "topic", "gap")
    none = mx.matrix_gaps(m, topics, m.filter("role = 'inicial'").select("role").distinct()).select(F.lit("one side").alias("present"), "topic", "gap")
    return out.unionByName(none)


@query
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    """A bundle for each source: the passages that a search finds, proofs,
    theses, and the search text that may go outside."""
    docs = t(spark, d, "documents")
    asks = docs.select("source").distinct().select(F.col("source").alias("case_id"), F.lit("pagamento licensed").alias("objetivo"), F.lit("autor").alias("lado")).filter("case_id IS NOT NULL")
    hits = se.bm25(asks.select(F.col("case_id").alias("query_id"), F.col("case_id").alias("source"), F.lit("the licensed").alias("query")), docs, 4, group=("source",))
    facts = hits.join(docs.select("doc_id", "text"), "doc_id").select(F.col("source").alias("case_id"), "rank", F.col("doc_id").cast("string").alias("evidence_id"), F.col("text").alias("trecho"))
    led = docs.filter("source IS NOT NULL").select(F.col("source").alias("case_id"), F.col("doc_id").alias("page"), F.when(F.col("n_chars") < 60, "comprovante").otherwise("outra").alias("piece_type"), F.array(F.col("doc_id").cast("string")).alias("evidence_ids"))
    items = (("oportunidade", "radar-0001", "tese a"), ("prazo", "radar-0002", "tese b"), ("prazo", "radar-0001", "tese c"), ("oportunidade", "radar-0003", "tese b"))
    radar = asks.select("case_id", F.explode(F.array(*(F.struct(F.lit(a).alias("lista"), F.lit(b).alias("radar_id"), F.lit(c).alias("hipotese")) for a, b, c in items))).alias("i")).select("case_id", "i.*")
    gaps = asks.select("case_id", F.array("lado").alias("critical_gaps"))
    names = asks.select("case_id", F.array(F.lit("Licensed")).alias("names"))
    b = mx.bundles(asks, facts, led, radar, gaps, names)
    return b.select(
        "case_id", F.array_join(F.transform("fatos", lambda s: F.concat_ws(":", s["evidence_id"], F.length(s["texto"]).cast("string"), F.length(s["trecho"]).cast("string"))), "|").alias("fatos"),
        F.array_join(F.transform("provas", lambda s: s["evidence_id"]), ",").alias("provas"), F.array_join("teses", "|").alias("teses"), F.size("lacunas").cast("long").alias("lacunas"), F.array_join("query_externa.fundamento", ",").alias("fundamento"),
    )


@query
def role_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each role, in the order of their pages."""
    o = t(spark, d, "orders")
    docs = o.select((F.col("o_custkey") % 20).alias("case_id"), F.col("o_orderkey").cast("string").alias("num"), (F.col("o_orderkey") * 3).alias("first_page"), (F.col("o_orderkey") * 3 + 1).alias("last_page"), piece_of(F.col("o_orderkey")).alias("piece_type"), F.concat(F.lit("ID "), "o_orderkey").alias("citacao"))
    return mx.role_pieces(docs)


@query
def proof_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    led = docs.select(F.col("source").alias("case_id"), F.col("doc_id").alias("page"), F.when(F.col("n_chars") < 400, "comprovante").otherwise("outra").alias("piece_type"), F.when(F.col("doc_id") % 4 > 0, F.array(F.concat(F.lit("e"), "doc_id"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    return mx.proof_pages(led)


@query
def outside_queries(spark: SparkSession, d: str) -> DataFrame:
    """Objective and missing concepts of the customer's case, without names."""
    c = t(spark, d, "customer")
    text = F.concat(F.lit("Cobrança de "), "c_name", F.lit(" por DANO MORAL e multa"))
    q = mx.bundle_query(F.concat(F.lit("cobranca contra "), "c_name"), text, F.array("c_name"))
    return c.select("c_custkey", q.alias("query"))


@query
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """JSON columns as arrays; what is no array is empty."""
    e = t(spark, d, "events")
    s = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "b"]'))).otherwise(F.col("props"))
    return e.select("event_id", F.array_join(tx.json_array(s), ",").alias("items"))


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages")
    return p.select("page_id", tx.page_file_name("page_id").alias("page_file"), tx.slug("url", 60, "documento").alias("file_slug"))


@query
def valid_dates(spark: SparkSession, d: str) -> DataFrame:
    """dd/mm dates are taken as they stand; here is which ones exist."""
    o = t(spark, d, "orders")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return o.select("o_orderkey", tx.date_is_valid(iso).alias("valid"))


@query
def retrieval_texts(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "documents")
    return c.select("doc_id", F.md5(se.retrieval_text(F.col("text"), "document")).alias("text_md5"), F.length(se.retrieval_text(F.col("text"), "query")).cast("long").alias("n_query"))


@query
def page_roles(spark: SparkSession, d: str) -> DataFrame:
    """The role of each page's document, outside where it has none."""
    o = t(spark, d, "orders")
    docs = o.select((F.col("o_custkey") % 20).alias("case_id"), F.col("o_orderkey").cast("string").alias("num"), (F.col("o_orderkey") * 3).alias("first_page"), (F.col("o_orderkey") * 3 + 1).alias("last_page"), piece_of(F.col("o_orderkey")).alias("piece_type"))
    pages = o.select((F.col("o_custkey") % 20).alias("case_id"), (F.col("o_orderkey") * 3 + F.col("o_orderkey") % 3).alias("page"))
    x = dm.page_to_document(pages, docs, carry=("piece_type",))
    return x.select("case_id", "page", F.when(F.col("piece_type").isNull(), mx.OUTSIDE).otherwise(mx.role_of(F.col("piece_type"))).alias("role"))


@query
def head_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first ten native pages with text of each case."""
    u = t(spark, d, "conversations").select((F.col("conv_id") % 50).alias("case_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("page"), F.when(F.col("turn") % 2 == 0, "page_text").otherwise("ocr_paragraph").alias("unit_type"), "text")
    return ev.head_units(u).select("case_id", "page")


@query
def radar_lists(spark: SparkSession, d: str) -> DataFrame:
    """Both lists of the radar as one per case, deadlines first."""
    r = ev.radar(ev.reconcile(raw_events(spark, d)), "autor", trigger="purchase")
    return ev.radar_union(r).select("case_id", F.size("itens").cast("long").alias("n"), F.md5(F.array_join(F.transform("itens", lambda s: F.concat_ws(":", s["lista"], s["radar_id"])), "|")).alias("items_md5"))


@query
def enrich_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages that a reader of uneven luck reads under ceilings of
    pages and calls: a seventh always fails, one is always empty, one fails
    once and one is empty twice."""
    from evidentia.streaming.ingest import attempt_rounds, outcome_state

    class Uneven:  # local, so that it travels to the workers by value
        name, prompt_version = "uneven", 1

        def read_attempt(self, case_id: str, page: int, attempt: int) -> tuple[str, int, int]:
            if page % 7 == 0 or page % 7 == 2 and attempt == 1:
                raise TimeoutError
            return ("" if page % 7 == 1 or page % 7 == 3 and attempt < 3 else "read"), 10, attempt

    k = F.col("o_custkey") % 50
    queue = t(spark, d, "orders").filter("o_orderkey % 3 = 0").select(k.cast("string").alias("case_id"), F.col("o_orderkey").cast("int").alias("page"), F.when(k % 3 == 0, 40).alias("max_pages"), F.when(k % 2 == 0, 50).alias("max_calls"))
    out = attempt_rounds(queue, Uneven(), backoff_ms=0)
    return out.select("case_id", "page", "attempts", outcome_state(F.col("error"), F.col("all_empty")).alias("state"), "tokens_in", "tokens_out", "error")


@query
def archive_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages of archives, one for each of twenty cases; two pages of
    three are settled and stay unparsed."""
    from evidentia.sources.paged import PagedSource, ZipPages

    root = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    Files(spark).write(f"{root}/about", "archives of pages")
    local = root.removeprefix("file://").removeprefix("file:")

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # page by page: an archive is never held as a whole
        store, at = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(local)
        n = 0
        with store.open_output_stream(f"{at}/case-{key[0].as_py()}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for conv, turn, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
                    z.writestr(f"{conv:020d}-{turn:020d}.txt", text or "")
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    c = t(spark, d, "conversations").select((F.col("conv_id") % 20).alias("k"), "conv_id", "turn", "text")
    c.groupBy("k").applyInArrow(pack, "n long").agg(F.sum("n")).collect()  # one number
    source = PagedSource(f"{root}/*.zip", ZipPages())
    settled = source.counts(spark).select("case_id", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page")).filter("page % 3 > 0")
    return source.pages(spark, settled).select("case_id", "page", F.md5("text").alias("text_md5"), "needs_enrichment")


@query
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown under their source as title: blocks by kind."""
    from evidentia.operators.markdown import markdown_blocks

    b = markdown_blocks(t(spark, d, "documents"), title="source")
    return b.groupBy("doc_id").agg(F.count_if(F.col("kind") == "title").alias("titles"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count(F.lit(1)).alias("n"))


@query
def result_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON text, as results are handed out."""
    return t(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("result"))
