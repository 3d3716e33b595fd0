"""Coverage accounting: ledger states, gaps, status, jobs, costs, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.functions.text import brl
from evidentia.operators.events import is_critical
from evidentia.operators.search import missing_vectors
from evidentia.rules import PT_LEGAL, RulePack

READ = ("native_extracted", "ocr_done", "done", "failed_permanent", "skipped_no_key")
NEEDED = ("ocr_needed", "ocr_running", "skipped_no_key")
QUEUE = ("ocr_needed", "skipped_no_key", "failed_retryable")
SETTLED = ("done", "ocr_done", "failed_permanent")
PROCESSED = ("done", "ocr_done", "failed_permanent", "failed_retryable", "skipped_no_key", "ocr_needed", "native_extracted")
UNREAD = ("pending", "ocr_needed", "skipped_no_key")
STALE_FACTOR, DEADLINE_MS = 4, 30_000
COST_PER_PAGE = (0.02, 0.05)


# ---------------------------------------------------------------- predicates


def in_queue(state: Column) -> Column:
    return state.isin(*QUEUE)


def is_visual(state: Column, yielded: Column) -> Column:
    """Pages whose meaning is in the image: the queue, those that failed for
    good, and those that gave only stamps."""
    return in_queue(state) | (state == "failed_permanent") | ((state == "ocr_done") & (F.coalesce(yielded, F.lit("")) == "stamp_only"))


def visual_queue(ledger: DataFrame, embedded: DataFrame, case: str = "case_id") -> DataFrame:
    """Visual pages without a vector of their own: embedded (case, page)."""
    seen = F.col("ocr_yield") if "ocr_yield" in ledger.columns else F.lit(None).cast("string")
    return ledger.filter(is_visual(F.col("state"), seen)).join(embedded.select(case, "page"), [case, "page"], "left_anti")


def textual_queue(units: DataFrame, ledger: DataFrame, vectors: DataFrame, model: str, case: str = "case_id") -> DataFrame:
    """Units with text whose page isn't visual and that lack a vector of the
    model."""
    visual = visual_queue(ledger, ledger.limit(0), case).select(case, "page")
    todo = missing_vectors(units, vectors, model, "evidence_id", "evidence_id")
    return todo.join(visual, [case, "page"], "left_anti")


def ledger_evidence(ledger: DataFrame, units: DataFrame, case: str = "case_id") -> DataFrame:
    """Units that the ledger's rows name, (case, position, evidence_id, ...),
    each once per case where it is named first, in the ledger's order.  Ids
    without a unit are left out; positions count them."""
    named = ledger.select(case, "page", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    first = named.groupBy(case, "evidence_id").agg(F.min(F.struct("page", "at")).alias("at"))
    n = F.row_number().over(W.partitionBy(case).orderBy("at", "evidence_id"))
    return first.select(case, "evidence_id", n.cast("long").alias("position")).join(units.drop(case, "position"), "evidence_id")


def skip_extracted(pages: DataFrame, ledger: DataFrame, case: str = "case_id") -> DataFrame:
    """``pages`` (case, page, hash, ...) that have to be done: no settled
    ledger row with the same hash."""
    prior = ledger.filter(F.col("state").isin(*SETTLED)).select(case, "page", F.col("page_hash").alias("hash"))
    return pages.join(prior, [case, "page", "hash"], "left_anti")


def nearest_ms(at: Column) -> Column:
    """Milliseconds since 1970 that are nearest to a time, halves away from 0:
    ``unix_millis`` cuts what is below a millisecond."""
    return F.round(F.unix_micros(at.cast("timestamp")) / 1000).cast("long")


def liveness(heartbeat: Column, now: Column, deadline_ms: Column | int = DEADLINE_MS, factor: int = STALE_FACTOR) -> Column:
    """struct(live, age_ms): whether the last sign is at most factor deadlines old."""
    age = nearest_ms(now) - nearest_ms(heartbeat)
    return F.struct((age <= deadline_ms * F.lit(factor)).alias("live"), age.alias("age_ms"))


def interrupted(jobs: DataFrame, now: Column, case: str = "case_id") -> DataFrame:
    """Jobs to resume at boot: in error, or running or queued without a recent
    sign; not the pause for approval, nor cases whose id starts with _."""
    stale = ~F.coalesce(liveness(F.col("last_heartbeat_at"), now, F.col("heartbeat_deadline_ms"))["live"], F.lit(False))
    return jobs.filter(~F.col(case).startswith("_") & ((F.col("status") == "error") | (F.col("status").isin("running", "queued") & stale)))


# ---------------------------------------------------------------- coverage


def _pages(when: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(when, F.col("page"))))


def never_extracted(cases: DataFrame, ledger: DataFrame, case: str = "case_id", block: int = 65_536) -> DataFrame:
    """Pages 1 to total_pages without a ledger row, (case, page).  The pages
    are generated block by block, so that a case of any size is spread over
    tasks."""
    blocks = cases.filter("total_pages > 0").select(case, "total_pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("total_pages") - 1) / block).cast("int"))).alias("_b"))
    pages = blocks.select(case, F.explode(F.sequence(F.col("_b").cast("long") * block + 1, F.least(F.col("total_pages").cast("long"), (F.col("_b").cast("long") + 1) * block))).alias("page"))
    return pages.join(ledger.select(case, F.col("page").cast("long").alias("page")), [case, "page"], "left_anti")


def gaps(cases: DataFrame, ledger: DataFrame, pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """Critical gaps, (case, kind, piece_type, n_pages, pages, reason): one per
    critical piece type with pages that wait for OCR, one for unknown unread
    pages, and one for pages never extracted, with its borders."""
    need = ledger.filter(F.col("state").isin(*NEEDED) & is_critical(F.col("piece_type"), F.lit(False), pack))
    a = need.groupBy(case, "piece_type").agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list("page")).cast("array<long>").alias("pages"))
    a = a.select(case, F.lit("critical_piece_incomplete").alias("kind"), "piece_type", "n_pages", "pages", F.lit("OCR pendente em paginas classificadas como peca critica").alias("reason"))
    unread = ledger.filter((F.col("piece_type") == "unknown") & (F.col("native_text_chars") == 0) & F.col("state").isin(*UNREAD))
    b = unread.groupBy(case).agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list("page")).cast("array<long>").alias("pages"))
    b = b.select(case, F.lit("unknown_unread_potentially_critical").alias("kind"), F.lit("unknown").alias("piece_type"), "n_pages", "pages", F.lit("Pagina nao lida sem classificacao confiavel").alias("reason"))
    m = never_extracted(cases, ledger, case).groupBy(case).agg(F.count(F.lit(1)).alias("n_pages"), F.array(F.min("page"), F.max("page")).alias("pages"))
    c = m.join(cases, case).select(
        case, F.lit("ingest_incomplete").alias("kind"), F.lit("unknown").alias("piece_type"), "n_pages", "pages",
        F.format_string("O PDF tem %d página(s) e apenas %d foram lidas — retome a preparação.", F.col("total_pages").cast("long"), F.col("total_pages").cast("long") - F.col("n_pages")).alias("reason"),
    )
    return a.unionByName(b).unionByName(c)


def coverage_manifest(cases: DataFrame, ledger: DataFrame, pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """One row per case: counts and page lists by state, gaps, and whether
    analysis of the whole case is allowed."""
    st = F.col("state")
    per = ledger.groupBy(case).agg(
        F.count_if(st.isin(*READ)).alias("pages_read"),
        _pages(st == "pending").alias("pages_pending"),
        _pages(st.isin(*NEEDED)).alias("pages_ocr_needed"),
        _pages(st == "ocr_done").alias("pages_ocr_done"),
        _pages(st == "failed_retryable").alias("pages_failed_retryable"),
        _pages(st == "failed_permanent").alias("pages_failed_permanent"),
        _pages((st == "ocr_done") & (F.col("ocr_yield") == "stamp_only")).alias("pages_ocr_stamp_only"),
        _pages((F.col("piece_type") == "unknown") & (F.col("native_text_chars") == 0) & st.isin(*UNREAD)).alias("pages_unknown_unread"),
    )
    g = gaps(cases, ledger, pack, case).groupBy(case).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.max(F.when(F.col("kind") == "ingest_incomplete", F.col("n_pages"))).alias("never_extracted"),
        F.array_sort(F.collect_list(F.struct("kind", "piece_type", "pages", "reason"))).alias("critical_gaps"),
    )
    out = cases.select(case, "total_pages").join(per, case, "left").join(g, case, "left")
    lists = [c for c in per.columns if c not in (case, "pages_read")]
    out = out.withColumns({c: F.coalesce(c, F.array().cast(per.schema[c].dataType)) for c in lists})
    n = F.coalesce("n_gaps", F.lit(0))
    stamp = F.size("pages_ocr_stamp_only")
    warn = F.array_compact(
        F.array(
            F.when(n > 0, "Analise global bloqueada: ha paginas criticas ainda nao lidas."),
            F.when(stamp > 0, F.concat(stamp.cast("string"), F.lit(" pagina(s) escaneadas cuja leitura rendeu apenas os carimbos digitais; confira o original antes de usar como prova."))),
        )
    )
    return out.withColumns(
        {
            "pages_read": F.coalesce("pages_read", F.lit(0)), "n_gaps": n, "never_extracted": F.coalesce("never_extracted", F.lit(0)),
            "critical_gaps": F.coalesce("critical_gaps", F.array().cast(g.schema["critical_gaps"].dataType)), "global_analysis_allowed": n == 0, "warnings": warn,
        }
    )


# ---------------------------------------------------------------- jobs and status


def latest_job(jobs: DataFrame, case: str = "case_id") -> DataFrame:
    """The newest job of each case, the larger id on ties."""
    cols = [c for c in jobs.columns if c != case]
    return jobs.groupBy(case).agg(F.max_by(F.struct(*cols), F.struct("created_at", "job_id")).alias("j")).select(case, "j.*")


def status_summary(jobs: DataFrame, ledger: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, status, total_pages, processed, n_needs_ocr, needs_ocr)."""
    last = latest_job(jobs, case)
    per = ledger.groupBy(case).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("state").isin(*READ)).alias("processed"),
        F.array_sort(F.collect_list(F.when(F.col("state").isin(*NEEDED), F.col("page")))).alias("needs_ocr"),
    )
    x = last.join(per, case, "left")
    none = F.array().cast(per.schema["needs_ocr"].dataType)
    return x.select(
        case, "status", F.greatest(F.coalesce("total_pages", F.lit(0)), F.coalesce("rows", F.lit(0))).cast("long").alias("total_pages"), F.coalesce("processed", F.lit(0)).alias("processed"),
        F.size(F.coalesce("needs_ocr", none)).alias("n_needs_ocr"), F.coalesce("needs_ocr", none).alias("needs_ocr"), *[c for c in ("last_heartbeat_at", "heartbeat_deadline_ms", "tokens") if c in last.columns],
    )


def compact_pages(pages: Column, most: int = 20, shown: int = 10) -> Column:
    """struct(pages, note): a long list cut to its first pages, with a note."""
    n = F.size(pages)
    note = F.when(n > most, F.concat(n.cast("string"), F.lit(" páginas escaneadas aguardando leitura (págs. "), pages[0].cast("string"), F.lit("–"), F.try_element_at(pages, F.lit(-1)).cast("string"), F.lit(f" do PDF); mostrando as {shown} primeiras.")))
    return F.struct(F.when(n > most, F.slice(pages, 1, shown)).otherwise(pages).alias("pages"), note.alias("note"))


def ocr_cost(pages: Column) -> Column:
    low, high = COST_PER_PAGE
    return F.concat(brl(pages * low), F.lit(" a "), brl(pages * high))


def next_action(status: Column, live: Column, pending: Column) -> Column:
    """What to call next; null when nothing is open."""
    running = status.isin("running", "queued")
    return (
        F.when(running & ~live, "retomar_ingestao (interrompida)")
        .when((status == "running") & live, "aguardar")
        .when(status == "paused_awaiting_ocr_approval", "autorizar_ocr")
        .when(status == "error", "retomar_ingestao")
        .when(pending > 0, "retomar_ingestao (paginas pendentes)")
    )


def status_view(summary: DataFrame, now: Column) -> DataFrame:
    """``status_summary`` with execution state, next action and costs."""
    lv = liveness(F.col("last_heartbeat_at"), now, F.coalesce("heartbeat_deadline_ms", F.lit(DEADLINE_MS)))
    running = F.col("status").isin("running", "queued")
    age = lv["age_ms"]
    state = F.when(running & lv["live"], F.concat(F.lit("preparação em andamento (último sinal há "), F.greatest(F.lit(1), F.round(age / 1000).cast("long")).cast("string"), F.lit("s)"))).when(
        running & ~lv["live"], F.concat(F.lit("preparação INTERROMPIDA há ~"), F.round(age / 60000).cast("long").cast("string"), F.lit(" min"))
    )
    c = compact_pages(F.col("needs_ocr"))
    return summary.withColumns({"execucao": state, "proxima_acao": next_action(F.col("status"), F.coalesce(lv["live"], F.lit(True)), F.col("n_needs_ocr")), "custo_estimado": F.when(F.col("n_needs_ocr") > 0, ocr_cost(F.col("n_needs_ocr"))), "needs_ocr_resumo": c["note"], "needs_ocr": c["pages"]})


def ocr_estimate(ledger: DataFrame, approvals: DataFrame | None, threshold: int = 25, case: str = "case_id") -> DataFrame:
    """(case, pending, requires_approval, approved, max_pages, max_calls); no
    approval row means none needed and approved, but consent needs max_pages."""
    p = ledger.groupBy(case).agg(F.count_if(in_queue(F.col("state"))).alias("pending"))
    p = p.withColumn("requires_approval", F.col("pending") > threshold)
    if approvals is None:
        return p.withColumns({"approved": F.lit(True), "max_pages": F.lit(None).cast("int"), "max_calls": F.lit(None).cast("int"), "may_run": ~F.col("requires_approval")})
    a = approvals.select(case, "approved", "max_pages", "max_calls")
    return p.join(a, case, "left").withColumn("approved", F.coalesce("approved", F.lit(True))).withColumn("may_run", ~F.col("requires_approval") | (F.col("approved") & F.col("max_pages").isNotNull()))


def final_status(ledger: DataFrame, cases: DataFrame, estimate: DataFrame, area_types: dict[str, tuple[str, ...]] | None = None, case: str = "case_id") -> DataFrame:
    """(case, final_status, alerts): error with fewer ledger rows than pages,
    paused while approval is missing, else done; an alert if pieces of the
    other area are found."""
    area_types = area_types or {"penal": ("denuncia", "resposta_acusacao", "alegacoes_finais")}
    other = F.col("piece_type").isin(*[t for v in area_types.values() for t in v])
    n = ledger.groupBy(case).agg(F.count(F.lit(1)).alias("rows"), F.count_if(other).alias("penal_pages"))
    x = cases.join(n, case, "left").join(estimate.select(case, "may_run", "pending"), case, "left")
    rows = F.coalesce("rows", F.lit(0))
    status = F.when(rows < F.col("total_pages"), "error").when(~F.coalesce("may_run", F.lit(True)), "paused_awaiting_ocr_approval").otherwise("done")
    area = F.coalesce(F.col("area"), F.lit("civil")) if "area" in cases.columns else F.lit("civil")
    alerts = F.array_compact(F.array(F.when(rows < F.col("total_pages"), "ingest_incomplete"), F.when(F.coalesce("pending", F.lit(0)) > 0, "ocr_pending"), F.when((area != "penal") & (F.coalesce("penal_pages", F.lit(0)) > 0), "area_mismatch")))
    return x.select(case, status.alias("final_status"), alerts.alias("alerts"))


def requeue_stamp_only(ledger: DataFrame, prompt_version: int) -> DataFrame:
    """Pages read under an older prompt (the first, if none is named) are looked
    at once per version: those that gave only stamps go back to the queue."""
    old = (F.col("state") == "ocr_done") & F.col("ocr_yield").isNotNull() & (F.coalesce("ocr_prompt_version", F.lit(1)) < prompt_version)
    again = old & (F.col("ocr_yield") == "stamp_only")
    return ledger.withColumns({"state": F.when(again, "ocr_needed").otherwise(F.col("state")), "ocr_prompt_version": F.when(old, F.lit(prompt_version)).otherwise(F.col("ocr_prompt_version"))})


# ---------------------------------------------------------------- panels


def piece_counts(documents: DataFrame, case: str = "case_id") -> DataFrame:
    """Documents per piece type, the most frequent first (``position``)."""
    c = documents.groupBy(case, "piece_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("position", F.row_number().over(W.partitionBy(case).orderBy(F.col("n").desc(), "piece_type")))


def case_listing(cases: DataFrame, facts: DataFrame, jobs: DataFrame, findings: DataFrame, case: str = "case_id") -> DataFrame:
    """One row per case, the last updated first: parties of at most 60
    characters, status, number of findings."""
    f = facts.groupBy(case).agg(*(F.substring(F.max(F.when(F.col("papel") == r, F.col("nome"))), 1, 60).alias(r) for r in ("autor", "reu")))
    j = latest_job(jobs, case).select(case, "status")
    d = findings.groupBy(case).agg(F.count(F.lit(1)).alias("achados"))
    x = cases.join(f, case, "left").join(j, case, "left").join(d, case, "left")
    return x.withColumn("achados", F.coalesce("achados", F.lit(0))).orderBy(F.col("updated_at").desc_nulls_last(), case)


def case_panel(cases: DataFrame, facts: DataFrame, coverage: DataFrame, documents: DataFrame, findings: DataFrame, min_pages: int = 20, shown: int = 5, case: str = "case_id") -> DataFrame:
    """One row per case: facts, coverage counts, documents per type, the first
    principal documents, and the dossier's size."""
    from evidentia.operators.docmap import is_principal

    pc = piece_counts(documents, case).groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece_type", "n"))), lambda s: F.struct(s["piece_type"].alias("tipo"), s["n"].alias("n"))).alias("pecas"), F.sum("n").alias("n_documentos"))
    pr = documents.filter(is_principal(F.col("piece_type"), F.col("pages"), min_pages)).withColumn("_r", F.row_number().over(W.partitionBy(case).orderBy("first_page", "num"))).filter(F.col("_r") <= shown)
    pr = pr.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "num", "piece_type", "citacao"))), lambda s: F.struct(s["num"].alias("num"), s["piece_type"].alias("tipo"), s["citacao"].alias("citacao"))).alias("principais"))
    f = facts.groupBy(case).agg(*(F.max(F.when(F.col("papel") == r, F.col("nome"))).alias(r) for r in ("autor", "reu", "valor")))
    cv = coverage.select(case, "pages_read", F.size("pages_pending").alias("n_pending"), F.size("pages_ocr_needed").alias("n_ocr_needed"), "n_gaps", "global_analysis_allowed")
    d = findings.groupBy(case).agg(F.count(F.lit(1)).alias("achados"))
    out = cases
    for t in (f, cv, pc, pr, d):
        out = out.join(t, case, "left")
    return out.withColumn("achados", F.coalesce("achados", F.lit(0)))
