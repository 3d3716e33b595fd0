"""The named queries as methods of an engine over a store of all cases.

Arguments are checked on the driver; results are DataFrames.  Opening a file on
a desktop has no place in a query engine and raises ``NotImplementedError``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import slug, strip_personal
from evidentia.operators import coverage as cov
from evidentia.operators import docmap as dm
from evidentia.operators import events as ev
from evidentia.operators import matrix as mx
from evidentia.operators import search as se
from evidentia.operators import verify as vf
from evidentia.rules import PT_LEGAL, RulePack
from evidentia.sources.pages import PageSource, total_pages, unsettled_pages
from evidentia.sources.docx import docx_bytes
from evidentia.sources.files import contained
from evidentia.sources.shared import written
from evidentia.sources.store import Store, append_findings, merge_registry, usage_totals
from evidentia.sources.tables import find_deadlines, load_deadlines, load_phases, pieces_of_phase
from evidentia.streaming.ingest import Budget, Embedder, Enricher, Lease, embed, enrich, ingest_batch, requeue


def between(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}")
    return value


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


@dataclass
class Engine:
    spark: SparkSession
    root: str
    pack: RulePack = field(default_factory=lambda: PT_LEGAL)
    embedder: Embedder | None = None
    enricher: Enricher | None = None
    deadline_paths: dict[str, str] = field(default_factory=dict)
    phases_path: str | None = None

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)
        self._scope: DataFrame | None = None

    def _t(self, table: str, case_id: str | None = None) -> DataFrame:
        """A table's rows, of one case if given, without those of deleted cases."""
        if self._scope is not None and case_id is None:
            read = lambda x: self.store.near(x, self._scope).join(self._scope, "case_id", "left_semi")
        else:
            read = lambda x: self.store.read(x, case_id)
        df = read(table)
        if table == "cases":
            return df.filter("deleted_at IS NULL")
        gone = read("cases").filter("deleted_at IS NOT NULL").select("case_id")
        return df.join(gone, "case_id", "left_anti")

    def _now(self):
        return F.current_timestamp()

    # 1-3, 17-19: cases and jobs

    def create_case(self, source: PageSource, area: str = "civil", now: str | None = None) -> DataFrame:
        """Take in all cases of a page source; their job rows."""
        one_of("area", area, ("civil", "penal"))
        at = F.lit(now).cast("timestamp") if now else self._now()
        counts = written(total_pages(source, self.spark))
        cases = counts.select("case_id", F.lit(area).alias("area"), "total_pages", at.alias("created_at"), at.alias("updated_at"))
        self.store.upsert("cases", cases)  # a case that was deleted is there again
        job = F.concat(F.lit("job-"), F.col("case_id"), F.lit("-"), F.date_format("created_at", "yyyyMMddHHmmss"))
        jobs = self._t("cases").join(counts.select("case_id"), "case_id", "left_semi").select(job.alias("job_id"), "case_id", F.lit("running").alias("status"), "area", "total_pages", "created_at", F.col("created_at").alias("last_heartbeat_at"), F.lit(cov.DEADLINE_MS).cast("long").alias("heartbeat_deadline_ms"))
        self.store.upsert("ingest_jobs", jobs)
        ingest_batch(self.store, unsettled_pages(source, self.spark, self._settled()), self.pack)
        return self.finish()

    def _settled(self, case_id: str | None = None) -> DataFrame:
        """Pages that don't have to be read again."""
        return self._t("page_ledger", case_id).filter(F.col("state").isin(*cov.SETTLED)).select("case_id", "page")

    def finish(self, case_id: str | None = None) -> DataFrame:
        """Final states of the latest jobs and estimates, written back."""
        led, cases = self._t("page_ledger", case_id), self._t("cases", case_id)
        est = cov.ocr_estimate(led, self._t("approvals", case_id))
        fin = cov.final_status(led, cases, est)
        jobs = cov.latest_job(self._t("ingest_jobs", case_id)).select("case_id", "job_id").join(fin, "case_id").select("job_id", "case_id", F.col("final_status").alias("status"), "alerts")
        self.store.patch("ingest_jobs", jobs)
        self.store.merge("approvals", est, lambda cur: merge_registry(cur, est.select("case_id", F.col("pending").cast("int").alias("estimated_pages")), ["case_id"]))
        return cov.latest_job(self._t("ingest_jobs", case_id))

    def status(self, case_id: str | None = None) -> DataFrame:
        """State, progress, costs and tokens of each case."""
        s = cov.status_view(cov.status_summary(self._t("ingest_jobs", case_id), self._t("page_ledger", case_id)), self._now())
        used = usage_totals(self._t("ocr_usage", case_id))
        est = self._t("approvals", case_id).select("case_id", "estimated_pages")
        return s.join(used, "case_id", "left").join(est, "case_id", "left")

    def job(self, job_id: str) -> DataFrame:
        return self._t("ingest_jobs").filter(F.col("job_id") == job_id)

    def list_cases(self) -> DataFrame:
        return cov.case_listing(self._t("cases"), ev.header_facts(self._t("evidence_units")), self._t("ingest_jobs"), self._t("findings"))

    def remove_case(self, case_id: str, confirm: str) -> None:
        """A soft delete; ``confirm`` must repeat the id."""
        if confirm != case_id:
            raise ValueError("the confirmation must equal the case id")
        self.store.patch("cases", self._t("cases", case_id).select("case_id", self._now().alias("deleted_at")))

    def approve(self, case_id: str, max_pages: int, max_calls: int) -> None:
        between("max_pages", max_pages, 1, 10**6), between("max_calls", max_calls, 1, 10**7)
        row = self.spark.createDataFrame([(case_id, True, max_pages, max_calls)], "case_id string, approved boolean, max_pages int, max_calls int").withColumn("approved_at", self._now())
        self.store.merge("approvals", row, lambda cur: merge_registry(cur, row, ["case_id"]))
        self.store.patch("ingest_jobs", cov.latest_job(self._t("ingest_jobs", case_id)).select("job_id", "case_id", F.lit("running").alias("status")))

    def resume(self, case_id: str, budget: Budget = Budget(), source: PageSource | None = None) -> DataFrame:
        """Go on with a case under a lease; refuses while another worker is live.

        Pages of ``source`` that aren't settled are read first; pages that gave
        only stamps go back to the queue once per prompt version; then the queue
        is read as far as approval and budget go.  A job that is done stays so
        unless there is something to do.
        """
        if self.enricher is None:
            raise ValueError("no enricher is configured")
        lease = Lease(self.spark, self.root, case_id)
        if not lease.acquire():
            raise RuntimeError("another worker is live on this case")
        try:
            if source is not None:
                ingest_batch(self.store, unsettled_pages(source, self.spark, self._settled(case_id)).filter(F.col("case_id") == case_id), self.pack)
            again = requeue(self.store, self.enricher.prompt_version, case_id)
            latest = cov.latest_job(self._t("ingest_jobs", case_id))
            waiting = not self._t("page_ledger", case_id).filter(cov.in_queue(F.col("state"))).isEmpty()
            if not (again or waiting or source is not None) and not latest.filter("status = 'done'").isEmpty():
                return latest
            lease.renew()
            enrich(self.store, self.enricher, budget, self.pack, case_id=case_id, owns=lease.owns)
            return self.finish(case_id)
        finally:
            lease.release()

    def resume_interrupted(self, budget: Budget = Budget(), most: int = 1000) -> dict[str, str]:
        """At start: the cases whose latest job broke off, each resumed under its
        lease, ``most`` at a time; their outcome.  Those that another worker has
        are left to it."""
        jobs = cov.interrupted(cov.latest_job(self._t("ingest_jobs")), self._now())
        told = {}
        for r in jobs.select("case_id").orderBy("case_id").limit(most).collect():
            try:
                told[r.case_id] = self.resume(r.case_id, budget).first().status
            except RuntimeError:
                told[r.case_id] = "another worker"
        return told

    def embed(self, max_calls: int = 2000, time_budget_s: float | None = 20.0) -> int:
        if self.embedder is None:
            raise ValueError("no embedder is configured")
        return embed(self.store, self.embedder, between("max_calls", max_calls, 1, 2000), time_budget_s=time_budget_s)

    def evidence(self, case_id: str | None = None) -> DataFrame:
        """The units that the ledger names, in its order."""
        return cov.ledger_evidence(self._t("page_ledger", case_id), self._t("evidence_units", case_id))

    #: What the artifacts are made of, and the columns that tell a change.
    INPUTS = {"cases": ("area", "total_pages", "updated_at"), "ingest_jobs": ("job_id", "status", "alerts"), "page_ledger": ("page", "page_hash", "state", "piece_type", "ocr_yield", "evidence_ids"), "evidence_units": ("evidence_id", "hash"), "approvals": ("approved", "max_pages", "max_calls", "estimated_pages")}

    def fingerprints(self) -> DataFrame:
        """(case_id, mark): a hash of everything that a case's artifacts show,
        the same in any order of rows."""
        parts = []
        for table, columns in self.INPUTS.items():
            h = F.xxhash64(F.lit(table), *columns)
            parts.append(self._t(table).groupBy("case_id").agg(F.bit_xor(h).alias("h"), F.count(F.lit(1)).alias("n"), F.lit(table).alias("t")))
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        marks = every.groupBy("case_id").agg(F.bit_xor(F.xxhash64("t", "h", "n")).alias("mark"))
        return marks.join(self._t("cases").select("case_id"), "case_id", "left_semi")

    def write_artifacts(self, folder: str) -> int:
        """Status, jobs, ledger and coverage, documents, events and radar as
        JSON lines, partitioned by case, below ``folder`` of the store.

        Only cases that have changed since the last call are computed and
        written, and those that are gone are removed; their number is returned.
        The marks of what was written are kept beside and replaced last, so that
        a call that broke off does its cases again.
        """
        root = contained(self.root, folder)
        files = self.store.files
        said = files.read(f"{root}/_marks/current")
        now = written(self.fingerprints())
        none = self.spark.createDataFrame([], "case_id string, mark long")
        old = self.spark.read.schema(none.schema).parquet(f"{root}/_marks/{said}") if said else none
        changed = written(now.join(old, ["case_id", "mark"], "left_anti").select("case_id"))
        gone = old.join(now, "case_id", "left_anti").select("case_id")
        n = changed.count() + gone.count()
        if not n:
            return 0
        with self._only(changed):
            civil = self._t("cases").filter("area <> 'penal'").select("case_id")
            raw = written(ev.extract_events(self._t("evidence_units").filter("text IS NOT NULL"), self.pack))
            events = written(ev.reconcile(raw))
            tables = {
                "status": self.status(), "job": cov.latest_job(self._t("ingest_jobs")), "ledger": self._t("page_ledger"), "coverage": self.coverage(), "documents": self.documents(),
                "events": events, "raw_events": raw, "radar": ev.radar_union(ev.radar(events.join(civil, "case_id", "left_semi"), "autor")),
            }
            for name, df in tables.items():
                rows = written(df)
                # a case that has no rows any more keeps no file
                for r in changed.unionByName(gone).join(rows.select("case_id").distinct(), "case_id", "left_anti").toLocalIterator():
                    files.delete(f"{root}/{name}/case_id={self._folder_name(r.case_id)}")
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").json(f"{root}/{name}")
        mark = uuid.uuid4().hex
        now.write.parquet(f"{root}/_marks/{mark}")
        files.write(f"{root}/_marks/current", mark)
        if said:
            files.delete(f"{root}/_marks/{said}")
        return n

    def _folder_name(self, value: str) -> str:
        """As Spark names the folder of a partition's value."""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    @contextmanager
    def _only(self, cases: DataFrame) -> Iterator[None]:
        """Tables read inside have the rows of these cases alone; only their
        buckets are read."""
        self._scope = cases
        try:
            yield
        finally:
            self._scope = None

    # 4-6, 16: panels

    def _stamped(self, case_id: str | None) -> DataFrame:
        pages = self._t("evidence_units", case_id).filter("unit_type = 'page_text'").select("case_id", "page", F.coalesce("text", F.lit("")).alias("text"))
        return dm.parse_stamps(pages)

    def documents(self, case_id: str | None = None) -> DataFrame:
        return dm.document_map(self._stamped(case_id), self._t("page_ledger", case_id))

    def events(self, case_id: str | None = None) -> DataFrame:
        return ev.reconcile(ev.extract_events(self._t("evidence_units", case_id).filter("text IS NOT NULL"), self.pack))

    def coverage(self, case_id: str | None = None) -> DataFrame:
        return cov.coverage_manifest(self._t("cases", case_id), self._t("page_ledger", case_id), self.pack)

    def case_panel(self, case_id: str | None = None) -> DataFrame:
        return cov.case_panel(self._t("cases", case_id), ev.header_facts(self._t("evidence_units", case_id)), self.coverage(case_id), self.documents(case_id), self._t("findings", case_id))

    def summary(self, case_id: str | None = None) -> DataFrame:
        return ev.summary(ev.header_facts(self._t("evidence_units", case_id)), self._t("page_ledger", case_id), self.events(case_id), self._t("cases", case_id), self.pack)

    def document_map(self, case_id: str, tipo: str | None = None, modo: str | None = None, limit: int = 50, offset: int = 0, min_paginas: int = 3) -> DataFrame:
        """Principal documents, or with a type or mode ``completo`` a page of all."""
        docs = self.documents(case_id)
        if tipo:
            docs = docs.filter(F.col("piece_type") == tipo)
        if one_of("modo", modo or ("completo" if tipo else "principais"), ("principais", "completo")) == "completo":
            return dm.page_of_documents(docs, limit, offset)
        return docs.filter(dm.is_principal(F.col("piece_type"), F.col("pages"), min_paginas)).orderBy("first_page")

    def document_groups(self, case_id: str, min_paginas: int = 3) -> DataFrame:
        return dm.remainder_groups(self.documents(case_id), min_paginas)

    def timeline(self, case_id: str | None = None, de: str | None = None, ate: str | None = None) -> DataFrame:
        return ev.timeline(self.events(case_id), self.documents(case_id), de, ate)

    def phase(self, case_id: str, fase_id: str | None = None) -> DataFrame:
        led = self._t("page_ledger", case_id).join(self._t("cases").select("case_id", F.when(F.col("area") == "penal", "penal").otherwise("civil").alias("area")), "case_id")
        if fase_id:
            if not self.phases_path:
                raise ValueError("no phase table is configured")
            area = "penal" if self._t("cases", case_id).filter("area = 'penal'").count() else "civil"
            return pieces_of_phase(load_phases(self.spark, self.phases_path), area, fase_id)
        return ev.phase(led, self.documents(case_id), F.col("area"), self.pack)

    # 7-9, 11: findings, search, reading

    def note_finding(self, case_id: str, achado: str, evidence_ids: list[str]) -> DataFrame:
        if not achado.strip() or not evidence_ids:
            raise ValueError("a finding needs a text and evidence")
        units = self._t("evidence_units", case_id)
        known = {r[0] for r in units.filter(F.col("evidence_id").isin(*evidence_ids)).select("evidence_id").collect()}
        if set(evidence_ids) - known:
            raise ValueError("unknown evidence: " + ", ".join(sorted(set(evidence_ids) - known)))
        new = self.spark.createDataFrame([(case_id, achado, evidence_ids)], "case_id string, achado string, evidence_ids array<string>")
        self.store.merge("findings", new, lambda cur: append_findings(cur, new, units, self._now()))
        return self.dossier(case_id)

    def dossier(self, case_id: str) -> DataFrame:
        return self._t("findings", case_id).orderBy("registrado_em", "achado_id")

    def search(self, case_id: str, queries: list[str] | str, limit: int = 10) -> DataFrame:
        """Hits with snippet and citation; hybrid where vectors are there."""
        between("limit", limit, 1, 50)
        queries = [queries] if isinstance(queries, str) else queries
        rows = [(str(i), q) for i, q in enumerate(queries)]
        units = self._t("evidence_units", case_id).filter("text IS NOT NULL")
        q = self.spark.createDataFrame(rows, "query_id string, query string")
        vectors = None
        if self.embedder is not None:
            space = self._t("evidence_vectors", case_id).filter(F.col("model") == self.embedder.model)
            if not space.isEmpty():
                vs = self.embedder.embed([f"task: search result | query: {x[:6000]}" for x in queries])
                q = self.spark.createDataFrame([(*r, v) for r, v in zip(rows, vs)], "query_id string, query string, qvec array<double>")
                vectors = space.select("evidence_id", F.col("vector").alias("embedding"))
        hits = se.hybrid(q, units, vectors, limit, "evidence_id", index=self._t("postings", case_id))
        snip = se.snippets(hits.select("query_id", "evidence_id"), q.select("query_id", "query"), units, "evidence_id", k=limit)
        cites = dm.page_citations(units.select("case_id", "page").distinct(), self.documents(case_id), self._stamped(case_id))
        u = units.select("evidence_id", "case_id", "page", "unit_id")
        return hits.join(snip, ["query_id", "evidence_id"]).join(u, "evidence_id").join(cites.select("case_id", "page", "num", "citacao"), ["case_id", "page"], "left").orderBy("query_id", "rank")

    def units(self, case_id: str) -> DataFrame:
        """A case's units in the order of its pages."""
        return self._t("evidence_units", case_id).orderBy("page", "unit_id")

    def open(self, case_id: str, evidence_id: str | None = None, page: int | None = None) -> DataFrame:
        if (evidence_id is None) == (page is None):
            raise ValueError("give an evidence id or a page")
        u = self._t("evidence_units", case_id)
        u = u.filter(F.col("evidence_id") == evidence_id) if evidence_id else u.filter((F.col("page") == page) & (F.col("unit_id") == "p001"))
        cites = dm.page_citations(u.select("case_id", "page").distinct(), self.documents(case_id), self._stamped(case_id))
        return u.join(cites, ["case_id", "page"], "left")

    # 14-15, 20-21: matrix, bundle, radar

    def topic_matrix(self, case_id: str, topics: dict[str, list[str]], limit: int = 4, primary: bool = True) -> tuple[DataFrame, DataFrame]:
        """Cells and gaps of 1 to 10 topics, each with its searches."""
        between("number of topics", len(topics), 1, 10), between("limit", limit, 1, 10)
        rows = [(t, i, q, f"{t}#{i}") for t, qs in topics.items() for i, q in enumerate(qs or [t])]
        q = self.spark.createDataFrame(rows, "topic string, query_idx int, query string, query_id string")
        units = self._t("evidence_units", case_id).filter("text IS NOT NULL")
        index = self._t("postings", case_id)
        hits = se.bm25(q.select("query_id", "query"), None, limit * 6, "evidence_id", index=index, stats=se.index_stats(index)).join(q.select("query_id", "topic", "query_idx"), "query_id")
        docs = self.documents(case_id)
        pages = dm.page_to_document(units.select("case_id", "page", "evidence_id"), docs, carry=("piece_type",))
        roles = pages.select("evidence_id", F.when(F.col("piece_type").isNull(), mx.OUTSIDE).otherwise(mx.role_of(F.col("piece_type"), self.pack)).alias("role"))
        m = mx.topic_matrix(hits, roles, limit, primary)
        return m, mx.matrix_gaps(m, q.select("topic").distinct(), docs.select(mx.role_of(F.col("piece_type"), self.pack).alias("role")).distinct())

    def role_pieces(self, case_id: str | None = None) -> DataFrame:
        """The documents that stand for each role, in their order."""
        return mx.role_pieces(self.documents(case_id), self.pack)

    def bundle(self, case_id: str, objective: str, side: str, max_items: int = 30, extra_names: list[str] | None = None) -> DataFrame:
        between("max_items", max_items, 1, 50), one_of("lado", side, ("autor", "reu"))
        searches = [f"{objective} {side}".strip(), *mx.FALLBACKS]
        units = self._t("evidence_units", case_id).filter("text IS NOT NULL")
        q = self.spark.createDataFrame([(str(i), s) for i, s in enumerate(searches)], "query_id string, query string")
        index = self._t("postings", case_id)
        hits = se.bm25(q, None, max_items, "evidence_id", index=index, stats=se.index_stats(index)).withColumn("alt", F.col("query_id").cast("int")).withColumn("case_id", F.lit(case_id))
        hits = mx.first_with_hits(hits, "case_id")
        snip = se.snippets(hits.select("query_id", "evidence_id", "case_id", "rank"), q, units, "evidence_id", k=max_items).withColumnRenamed("snippet", "trecho")
        names = ev.header_facts(units).filter("papel <> 'valor'").groupBy("case_id").agg(F.collect_list("nome").alias("names"))
        names = self._t("cases", case_id).select("case_id").join(names, "case_id", "left").select("case_id", F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(*map(F.lit, extra_names or [])).cast("array<string>")).alias("names"))
        ask = self.spark.createDataFrame([(case_id, objective, side)], "case_id string, objetivo string, lado string")
        return mx.bundles(ask, snip.select("case_id", "rank", "evidence_id", "trecho"), self._t("page_ledger", case_id), ev.radar(self.events(case_id), side), self.coverage(case_id), names, self.pack)

    def radar(self, case_id: str, side: str) -> DataFrame:
        one_of("lado", side, ("autor", "reu"))
        if self._t("cases", case_id).filter("area = 'penal'").count():
            raise ValueError("the radar covers civil cases only")
        table = load_deadlines(self.spark, self.deadline_paths["civel"]) if "civel" in self.deadline_paths else None
        return ev.radar(self.events(case_id), side, table)

    def analyze(self, case_id: str, objective: str, side: str, max_items: int = 30) -> dict[str, DataFrame]:
        return {"coverage": self.coverage(case_id), "radar": self.radar(case_id, side), "bundle": self.bundle(case_id, objective, side, max_items)}

    # 22-24: references

    def deadlines(self, table: str = "civel", act: str | None = None) -> DataFrame:
        one_of("tabela", table, ("civel", "penal"))
        if table not in self.deadline_paths:
            raise ValueError(f"no deadline table is configured for {table}")
        return find_deadlines(load_deadlines(self.spark, self.deadline_paths[table]), act)

    def register_docs(self, case_id: str, docs: list[dict[str, str]]) -> DataFrame:
        if not docs or any(not d.get("doc_id") for d in docs):
            raise ValueError("every document needs a doc_id")
        cols = ("doc_id", "titulo", "ementa", "tribunal", "url")
        new = self.spark.createDataFrame([(case_id, *(d.get(c) for c in cols)) for d in docs], "case_id string, " + ", ".join(f"{c} string" for c in cols))
        self.store.merge("registry", new, lambda cur: merge_registry(cur, new, ["case_id", "doc_id"]))
        return self._t("registry", case_id)

    def verify(self, case_id: str, evidence_ids: list[str] = (), doc_ids: list[str] = (), claims: list[dict] | None = None) -> DataFrame:
        e = self.spark.createDataFrame([(x,) for x in evidence_ids], "evidence_id string")
        d = self.spark.createDataFrame([(x,) for x in doc_ids], "doc_id string")
        return vf.verify_references(e, d, self._claims(claims), self._t("evidence_units", case_id), self._t("registry", case_id))

    def verify_claims(self, case_id: str, claims: list[dict]) -> DataFrame:
        return vf.verify_claims(self._claims(claims), self._t("evidence_units", case_id), self._t("registry", case_id))

    def _claims(self, claims: list[dict] | None) -> DataFrame | None:
        if not claims:
            return None
        rows = [(c.get("claim_id") or str(i), c["afirmacao"], [(s["evidence_id"], s.get("trecho_base")) for s in c.get("supports", [])], c.get("doc_ids")) for i, c in enumerate(claims)]
        return self.spark.createDataFrame(rows, "claim_id string, afirmacao string, supports array<struct<evidence_id:string,trecho_base:string>>, doc_ids array<string>")

    def outside_text(self, text: str, names: list[str]) -> str:
        """A text as it may leave the house."""
        return self.spark.range(1).select(strip_personal(F.lit(text), names)).first()[0]

    # 12-13

    def export_document(self, title: str, text: str) -> str:
        """A Markdown text as a word-processor file below the store's root; its
        path."""
        if not title.strip() or not text.strip():
            raise ValueError("a document needs a title and a text")
        name = self.spark.range(1).select(slug(F.lit(title), 60, "documento")).first()[0]
        path = contained(self.root, "documents", f"{name}.docx")
        self.store.files.write_bytes(path, docx_bytes(title, text))
        return path

    def open_on_desktop(self, *_: object) -> None:
        raise NotImplementedError("opening files on a desktop is outside a query engine")
