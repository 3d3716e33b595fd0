import pytest

from evidentia.plans.api import Engine
from evidentia.sources.store import Store, check_units
from evidentia.streaming.ingest import Budget, Lease, TrigramEmbedder, ingest_stream
from evidentia.sources.pages import TableSource

PAGES = [
    ("caso", 1, "Num. 10 - Pág. 1 PETIÇÃO INICIAL. AUTOR: MARIA SOUZA, em face de Banco Y. Pagamento em 01/02/2024 no valor de R$ 500,00 conforme contrato."),
    ("caso", 2, "Num. 10 - Pág. 2 Mandado de citação cumprido por oficial de justiça em 05/03/2024, juntado aos autos em 07/03/2024 pelo cartório."),
    ("caso", 3, "Num. 11 - Pág. 1 CONTESTAÇÃO do banco que nega o pagamento e alega prescrição do contrato discutido nestes autos."),
    ("caso", 4, ""),
]


def reader():
    class Reader:  # local, so that it travels to the workers by value
        name, prompt_version = "stub", 1

        def read(self, case_id, page):
            return ("comprovante de pagamento via pix lido na imagem " * 4, 10, 20)

    return Reader()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    spark.createDataFrame(PAGES, "case_id string, page int, text string").write.parquet(str(root / "in"))
    e = Engine(spark, str(root / "s"), embedder=TrigramEmbedder(), enricher=reader())
    e.create_case(TableSource(str(root / "in")), now="2024-05-01 00:00:00")
    return e


def test_lifecycle(engine):
    assert engine.status("caso").first().n_needs_ocr == 1
    hits = engine.search("caso", "citacao").collect()
    assert hits[0].page == 2 and "«" in hits[0].snippet and hits[0].citacao == "ID 10, pág. 2" and hits[0]["mode"] == "lexical"
    assert engine.embed() == 3 and engine.embed() == 0
    assert engine.search("caso", "citações").first()["mode"] == "hybrid"
    assert {r.tipo for r in engine.events("caso").collect()} == {"citacao"}
    assert [r.data for r in engine.timeline("caso").collect()][0] == "2024-03-05"
    assert engine.radar("caso", "autor").count() == 2
    assert engine.phase("caso").first().fase_id == "defesa"
    m, gaps = engine.topic_matrix("caso", {"pagamento": []})
    assert {(r.role, r.evidence_id[-14:]) for r in m.collect()} == {("inicial", "page:1:unit:p001"[-14:]), ("contestacao", "page:3:unit:p001"[-14:])} and gaps.count() == 0
    b = engine.bundle("caso", "pagamento MARIA SOUZA", "autor").first()
    assert b.fatos and b.query_externa.query == "pagamento [parte]"
    assert engine.case_panel("caso").first().autor == "MARIA SOUZA" and engine.list_cases().count() == 1
    assert "autor: MARIA SOUZA" in engine.summary("caso").first().resumo
    assert set(engine.analyze("caso", "x", "reu")) == {"coverage", "radar", "bundle"}
    assert engine.document_map("caso").count() == 2 and engine.document_map("caso", tipo="inicial").first().has_more is False
    assert engine.open("caso", page=3).first().citacao == "ID 11, pág. 1"
    eid = "case:caso:page:1:unit:p001"
    engine.note_finding("caso", "pagou", [eid])
    assert engine.note_finding("caso", "pagou", [eid]).count() == 1
    with pytest.raises(ValueError):
        engine.note_finding("caso", "x", ["nada"])
    engine.register_docs("caso", [{"doc_id": "d1", "titulo": "a"}])
    assert engine.register_docs("caso", [{"doc_id": "d1", "ementa": "b"}]).first().titulo == "a"
    assert engine.verify("caso", [eid], ["d1"]).first().ok and not engine.verify("caso", ["zz"], ["d9"]).first().ok
    assert engine.verify_claims("caso", [{"afirmacao": "em 01/02/2024", "supports": [{"evidence_id": eid, "trecho_base": "pagamento em 01/02/2024"}]}]).first().status == "ok"


def test_resume_reads_the_queue_once(engine):
    lease = Lease(engine.spark, engine.root, "caso")
    assert lease.acquire()
    with pytest.raises(RuntimeError):
        engine.resume("caso")
    lease.release()
    engine.resume("caso", Budget(backoff_ms=1))
    s = engine.status("caso").first()
    assert s.n_needs_ocr == 0 and s.status == "done"
    led = engine.store.read("page_ledger").filter("page = 4").first()
    assert led.state == "ocr_done" and led.piece_type == "comprovante"
    assert engine.search("caso", "pix").first().page == 4


def test_done_is_done_until_the_prompt_changes(engine):
    led = lambda: engine.store.read("page_ledger", "caso").filter("page = 4").first()
    before = led().updated_at
    assert engine.resume("caso").first().status == "done" and led().updated_at == before
    engine.store.patch("page_ledger", engine.spark.createDataFrame([("caso", 4, "stamp_only")], "case_id string, page int, ocr_yield string"))
    engine.enricher.__class__.prompt_version = 2
    engine.resume("caso", Budget(backoff_ms=1))
    assert led().ocr_yield == "content" and led().ocr_prompt_version == 2 and led().updated_at > before


def test_status_has_tokens_and_estimates(engine):
    s = engine.status("caso").first()
    assert s.tokens_in == 20 and s.tokens_out == 40 and s.estimated_pages == 0
    assert engine.job(engine.store.read("ingest_jobs").first().job_id).first().case_id == "caso"


def test_evidence_in_the_ledgers_order(engine):
    got = [(r.position, r.page, r.unit_id) for r in engine.evidence("caso").orderBy("position").collect()]
    assert got == [(1, 1, "p001"), (2, 2, "p001"), (3, 3, "p001"), (4, 4, "p001"), (5, 4, "ocr001")]


def test_artifacts(engine, spark):
    engine.write_artifacts("artifacts")
    read = lambda x: spark.read.json(f"{engine.root}/artifacts/{x}")
    assert read("ledger").count() == 4 and read("raw_events").first().tipo == "citacao" and read("coverage").first().case_id == "caso" and read("radar").count() == 1
    with pytest.raises(ValueError):
        engine.write_artifacts("../out")


def test_interrupted_jobs_go_on_and_deleted_cases_are_gone(engine, spark, tmp_path):
    spark.createDataFrame([("dois", 1, ""), ("dois", 2, "PETIÇÃO INICIAL de outro processo com texto bastante para a leitura.")], "case_id string, page int, text string").write.parquet(str(tmp_path / "in"))
    engine.create_case(TableSource(str(tmp_path / "in")), now="2024-05-02 00:00:00")
    job = engine.store.read("ingest_jobs", "dois").select("job_id")
    engine.store.patch("ingest_jobs", job.selectExpr("job_id", "'running' AS status"))  # its last sign is old
    busy = Lease(engine.spark, engine.root, "dois")
    assert busy.acquire() and engine.resume_interrupted(Budget(backoff_ms=1)) == {"dois": "another worker"}
    busy.release()
    assert engine.resume_interrupted(Budget(backoff_ms=1)) == {"dois": "done"} and engine.resume_interrupted() == {}
    assert engine.list_cases().count() == 2 and engine.search("dois", "inicial").count() == 1
    engine.remove_case("dois", "dois")
    assert engine.list_cases().count() == 1 and engine.search("dois", "inicial").count() == 0 and engine.status("dois").count() == 0 and engine.evidence("dois").count() == 0
    assert engine.search("caso", "citacao").count() > 0


def test_a_lost_lease_stores_nothing(engine, spark, tmp_path):
    from evidentia.streaming.ingest import LeaseLost, enrich

    store = Store(spark, str(tmp_path))
    store.upsert("page_ledger", spark.createDataFrame([("a", 1, "ocr_needed")], "case_id string, page int, state string"))
    asked = iter([True, False])
    with pytest.raises(LeaseLost):
        enrich(store, reader(), Budget(backoff_ms=1), owns=lambda: next(asked))
    assert store.read("page_ledger").first().state == "ocr_needed" and store.read("evidence_units").count() == 0


def test_embedding_in_rounds(spark, tmp_path):
    from evidentia.streaming.ingest import embed

    class Pages:  # local, so that it travels to the workers by value
        model = "m"

        def embed(self, texts):
            return [[1.0, float(len(t))] for t in texts]

        def embed_pages(self, pages):
            assert len(pages) <= 4
            return [[2.0, float(p)] for _, p in pages]

    store = Store(spark, str(tmp_path))
    store.upsert("evidence_units", spark.createDataFrame([(f"case:a:page:{p}:unit:p001", "a", p, "p001", "t" * p) for p in range(1, 8)], "evidence_id string, case_id string, page int, unit_id string, text string"))
    store.upsert("page_ledger", spark.createDataFrame([("a", p, "done" if p < 6 else "ocr_needed") for p in range(1, 8)], "case_id string, page int, state string"))
    late = iter([0.0, 100.0])
    assert embed(store, Pages(), batch=2, calls_per_round=1, time_budget_s=5.0, clock=lambda: next(late)) == 2
    assert embed(store, Pages(), max_calls=1, batch=2) == 2
    assert embed(store, Pages(), batch=2) == 3 and embed(store, Pages()) == 0
    got = {r.evidence_id.split(":page:")[1]: list(r.vector) for r in store.read("evidence_vectors").collect()}
    assert got["6:unit:img001"] == [2.0, 6.0] and "6:unit:p001" not in got and len(got) == 7


def test_exported_document(engine, spark):
    import io
    import xml.etree.ElementTree as et
    import zipfile

    path = engine.export_document("Peça: réplica", "# Um **título**\n\ntexto & *mais* `x<y`\n- item\n> dito\n| a | b |\n|--|--|\n| 1 | 2 |")
    assert path.endswith("/documents/peca-replica.docx")
    raw = bytes(spark.read.format("binaryFile").load(path).first().content)
    z = zipfile.ZipFile(io.BytesIO(raw))
    root = et.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = ["".join(t.text for t in p.iter(w + "t")) for p in root.iter(w + "p")]
    assert text == ["Um título", "texto & mais x<y", "• item", "dito", "a", "b", "1", "2", ""] and len(z.namelist()) == 3
    with pytest.raises(ValueError):
        engine.export_document(" ", "x")


def test_stored_index_equals_a_scan(engine, spark):
    from evidentia.operators import search as se

    q = spark.createDataFrame([("a", "pagamento contrato"), ("b", "citação zzz"), ("c", "!!")], "query_id string, query string")
    units = engine.store.read("evidence_units", "caso").filter("text IS NOT NULL")
    index = engine.store.read("postings", "caso")
    got = se.bm25(q, None, 5, "evidence_id", index=index, stats=se.index_stats(index))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, se.bm25(q, units, 5, "evidence_id").collect())) and got.count() == 3


def test_arguments(engine):
    for f in (lambda: engine.search("caso", "x", 51), lambda: engine.open("caso"), lambda: engine.remove_case("caso", "x"), lambda: engine.radar("caso", "z"), lambda: engine.topic_matrix("caso", {})):
        with pytest.raises(ValueError):
            f()


def test_stream_is_incremental_and_idempotent(spark, tmp_path):
    src, store = tmp_path / "pages", Store(spark, str(tmp_path / "st"))
    df = spark.createDataFrame([(*r, False) for r in PAGES], "case_id string, page int, text string, needs_enrichment boolean")
    df.filter("page <= 2").write.mode("append").parquet(str(src))
    ingest_stream(store, str(src), str(tmp_path / "ck"))
    assert store.read("page_ledger").count() == 2
    df.write.mode("append").parquet(str(src))
    ingest_stream(store, str(src), str(tmp_path / "ck"))
    assert store.read("page_ledger").count() == 4 and store.read("evidence_units").count() == 4


def test_bad_offsets_reject_the_whole_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"))
    good = spark.createDataFrame([("a", 0, 5)], "evidence_id string, start_offset int, end_offset int")
    bad = spark.createDataFrame([("b", 0, 5), ("c", 5, 1)], "evidence_id string, start_offset int, end_offset int")
    store.upsert("evidence_units", good)
    with pytest.raises(Exception):
        store.upsert("evidence_units", bad)
    assert [r.evidence_id for r in store.read("evidence_units").collect()] == ["a"]
    assert check_units(good).count() == 1
