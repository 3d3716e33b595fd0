import sqlite3

from pyspark.sql import functions as F

from evidentia.operators import coverage as cov
from evidentia.operators import docmap as dm
from evidentia.operators import events as ev
from evidentia.operators import search as se
from evidentia.operators import verify as vf

TEXTS = ["a citação do réu em juízo", "citacao e mandado e citacao", "outra página sem nada", "R$ 52.340,18 de multa e valor", "", "valor de 52 e 340"]


def units(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def run(spark, q, k=10, texts=TEXTS):
    return se.bm25(spark.createDataFrame([("q", q)], "query_id string, query string"), units(spark, texts), k).orderBy("rank").collect()


def test_bm25_equals_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text)")
    for i, t in enumerate(TEXTS):
        db.execute("insert into f(rowid, text) values (?, ?)", (i, t))
    for q in ("citacao", "citacao mandado", "valor de", "pagina"):
        want = dict(db.execute("select rowid, bm25(f) from f where f match ?", (" ".join(f'"{t}"' for t in q.split()),)).fetchall())
        got = {r.doc_id: r.score for r in run(spark, q)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_accents_fallback_and_punctuation(spark):
    assert {r.doc_id for r in run(spark, "CITAÇÃO")} == {0, 1}
    assert {(r.doc_id, r["mode"]) for r in run(spark, "citacao multa")} == {(0, "or"), (1, "or"), (3, "or")}
    assert [r.doc_id for r in run(spark, "R$ 52.340,18")][0] == 3
    assert run(spark, "!!!") == [] and run(spark, "inexistente") == []


def test_empty_tables(spark):
    e = units(spark).limit(0)
    assert se.bm25(spark.createDataFrame([("q", "x")], "query_id string, query string"), e).count() == 0
    assert se.term_stats(e).count() == 0


def test_snippet_marks(spark):
    q = spark.createDataFrame([("q", "citacao")], "query_id string, query string")
    s = se.snippets(se.bm25(q, units(spark)).select("query_id", "doc_id"), q, units(spark)).collect()
    assert all("«" in r.snippet for r in s) and any("«citação»" in r.snippet for r in s)


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 3.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, qvec array<float>")
    top = se.vector_topk(q, v, 2).orderBy("rank").collect()
    assert [r.vec_id for r in top] == [0, 1] and abs(top[1].score - 0.70710678) < 1e-6
    lex = spark.createDataFrame([("q", 5, 1), ("q", 6, 2)], "query_id string, doc_id long, rank int")
    sem = spark.createDataFrame([("q", 6, 1), ("q", 7, 2)], "query_id string, doc_id long, rank int")
    assert [r.doc_id for r in se.rrf(lex, sem).orderBy("rank").collect()] == [6, 5, 7]


def pages(spark, rows):
    return dm.parse_stamps(spark.createDataFrame(rows, "case_id string, page int, text string"))


def test_source_systems(spark):
    rows = [("pje", 1, "Num. 77 - Pág. 1"), ("pje", 2, "x"), *(("ep", i, "Evento 12 - PET1 / Página 3") for i in range(1, 4)), ("ep", 4, "x"), *(("stj", i, f"(e-STJ Fl.{i + 100})") for i in range(1, 4)), ("few", 1, "Evento 1 PET1"), ("few", 2, "y"), ("few", 3, "y")]
    got = {r.case_id: r.sistema for r in dm.source_system(pages(spark, rows)).collect()}
    assert got == {"pje": "pje", "ep": "eproc", "stj": "estj", "few": "desconhecido"}


def test_map_overlaps_and_citations(spark):
    s = pages(spark, [("c", 1, "Num. 1 - Pág. 1 Assinado eletronicamente por: ANA - 02/03/2024"), ("c", 2, "Num. 2 - Pág. 1"), ("c", 3, "Num. 1 - Pág. 3"), ("c", 4, "Num. 2 - Pág. 2"), ("c", 6, "")])
    led = spark.createDataFrame([("c", 1, "inicial"), ("c", 2, "contestacao")], "case_id string, page int, piece_type string")
    d = dm.document_map(s, led)
    rows = {r.num: r for r in d.collect()}
    assert (rows["1"].first_page, rows["1"].last_page, rows["1"].pages, rows["1"].signed_date, rows["1"].signer, rows["1"].piece_type) == (1, 3, 2, "2024-03-02", "ANA", "inicial")
    ask = spark.createDataFrame([("c", p) for p in range(1, 7)], "case_id string, page int")
    got = {r.page: r.citacao for r in dm.page_citations(ask, d, s).collect()}
    assert got == {1: "ID 1, pág. 1", 2: "ID 1, pág. 2", 3: "ID 1, pág. 3", 4: "ID 2, pág. 3", 5: None, 6: None}


def test_page_to_document_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    docs = [("c", str(i), a, a + rnd.randint(0, 3000)) for i, a in enumerate(rnd.randint(0, 9000) for _ in range(40))]
    asks = [("c", rnd.randint(0, 12_500)) for _ in range(500)]
    d = spark.createDataFrame(docs, "case_id string, num string, first_page int, last_page int").withColumn("piece_type", F.lit("x"))
    got = {r.page: r.num for r in dm.page_to_document(spark.createDataFrame(asks, "case_id string, page int"), d).collect()}
    for _, p in asks:
        hit = sorted((x for x in docs if x[2] <= p <= x[3]), key=lambda x: (x[2], x[1]))
        assert got[p] == (hit[0][1] if hit else None)


def test_classification(spark):
    cases = [("Petição inicial e contestação", "inicial"), ("impugnação à contestação", "replica"), ("denunciação da lide", "unknown"), ("DENÚNCIA e inicial", "denuncia"), ("Despacho", "decisao")]
    for text, want in cases:
        r = spark.range(1).select(ev.classify(F.lit(text), F.lit(True)).alias("c")).first().c
        assert r.piece_type == want and r.confidence == (0.35 if want == "unknown" else 0.85)
    r = spark.range(1).select(ev.classify(F.lit("x"), F.lit(False)).alias("c"), ev.classify(F.lit("x"), F.lit(True), previous=F.lit("sentenca")).alias("p")).first()
    assert (r.c.piece_type, r.c.confidence, r.p.piece_type, r.p.confidence) == ("unknown", 0.1, "sentenca", 0.45)


def raw(spark, rows):
    cols = "raw_event_id string, tipo string, subtipo string, modalidade string, data_documento string, data_juntada string, evidence_ids array<string>"
    return spark.createDataFrame(rows, cols).withColumns({"case_id": F.lit("c"), "fonte_data": F.lit("t"), "descricao": F.lit("d"), "reading_confidence": F.lit(0.9), "extraction_confidence": F.lit(0.8)})


def test_reconcile(spark):
    e = lambda p: [f"case:c:page:{p}:unit:p001"]
    same = ev.reconcile(raw(spark, [("r1", "citacao", None, None, "2024-01-01", None, e(5)), ("r2", "citacao", None, None, "2024-01-01", None, e(3))])).collect()
    assert len(same) == 1 and same[0].evidence_ids == e(3) + e(5) and same[0].status == "reconciled" and same[0].event_id.startswith("evt-")
    two = ev.reconcile(raw(spark, [("r1", "citacao", None, None, "2024-01-01", None, e(5)), ("r2", "citacao", None, None, "2024-01-02", None, e(5))])).collect()
    assert len(two) == 2 and {r.status for r in two} == {"ambiguous"}
    assert ev.reconcile(raw(spark, [("x", "a", None, None, None, None, e(1))]).limit(0)).count() == 0


def test_header_facts(spark):
    text = "IMPETRANTE: FULANO DE TAL IMPETRADO : SECRETÁRIO em face de Banco X, ... valor da causa: R$ 1.000,00"
    u = spark.createDataFrame([("c", 1, "p001", "page_text", "e1", text)], "case_id string, page int, unit_id string, unit_type string, evidence_id string, text string")
    got = {r.papel: (r.nome, r.confianca) for r in ev.header_facts(u).collect()}
    assert got["autor"] == ("FULANO DE TAL", 0.9) and got["valor"][0] == "R$ 1.000,00" and got["reu"][1] == 0.9


def test_phase(spark):
    rows = [("a", 1, "inicial"), ("a", 2, "sentenca"), ("a", 3, "recurso"), ("b", 1, "recurso"), ("b", 2, "unknown"), ("d", 4, "inicial")]
    got = {r.case_id: (r.fase_id, r.confianca) for r in ev.phase(spark.createDataFrame(rows, "case_id string, page int, piece_type string")).collect()}
    assert got == {"a": ("recursal", "alta"), "b": ("nao-identificavel", "media"), "d": ("postulatoria", "media")}


LED = "case_id string, page int, state string, piece_type string, native_text_chars int, ocr_yield string"


def test_coverage(spark):
    cases = spark.createDataFrame([("c", 5), ("ok", 1)], "case_id string, total_pages int")
    led = spark.createDataFrame([("c", 1, "done", "inicial", 9, None), ("c", 2, "ocr_needed", "sentenca", 0, None), ("c", 3, "skipped_no_key", "unknown", 0, None), ("ok", 1, "ocr_done", "unknown", 0, "stamp_only")], LED)
    m = {r.case_id: r for r in cov.coverage_manifest(cases, led).collect()}
    assert m["c"].pages_read == 2 and m["c"].pages_ocr_needed == [2, 3] and m["c"].never_extracted == 2 and not m["c"].global_analysis_allowed
    assert {g.kind for g in m["c"].critical_gaps} == {"critical_piece_incomplete", "unknown_unread_potentially_critical", "ingest_incomplete"}
    assert m["ok"].global_analysis_allowed and len(m["ok"].warnings) == 1
    assert cov.coverage_manifest(cases.limit(0), led.limit(0)).count() == 0


def test_claims(spark):
    u = spark.createDataFrame([("e1", "O contrato foi assinado em 01/02/2024 por R$ 500,00.")], "evidence_id string, text string")
    S = [("e1", "CONTRATO foi  assinado em 01/02/2024")]
    rows = [
        ("ok", "assinado em 01/02/2024", S, ["d1"]), ("forged", "x", [("e1", "nunca escrito")], None), ("unknown", "x", [("zz", "contrato")], None), ("literal", "em 03/02/2024", S, None),
        ("doc", "x", S, ["d9"]), ("none", "x", [], None), ("null", None, None, None),
    ]
    c = spark.createDataFrame(rows, "claim_id string, afirmacao string, supports array<struct<evidence_id:string,trecho_base:string>>, doc_ids array<string>")
    reg = spark.createDataFrame([("d1",)], "doc_id string")
    got = {r.claim_id: r.status for r in vf.verify_claims(c, u, reg).collect()}
    assert got == {"ok": "ok", "forged": "trecho_nao_encontrado", "unknown": "evidencia_inexistente", "literal": "literal_nao_suportado", "doc": "doc_id_nao_registrado", "none": "evidencia_inexistente", "null": "evidencia_inexistente"}


def test_ages_count_from_the_nearest_millisecond(spark):
    """As the SQL's epoch_ms: 149,999.4 ms ago is 149,999 and so two minutes, not 150,000 and three."""
    import duckdb

    signs = ["2024-05-31 23:57:30.000600", "2024-05-31 23:57:30.000500", "2024-05-31 23:57:30.000499", "2024-05-31 23:57:29.999500", "1969-12-31 23:59:59.998500"]
    df = spark.createDataFrame([(s,) for s in signs], "s string")
    age = cov.liveness(F.col("s"), F.lit("2024-06-01 00:00:00"))["age_ms"]
    want = [duckdb.execute("select epoch_ms(timestamp '2024-06-01') - epoch_ms(?::timestamp)", [s]).fetchall()[0][0] for s in signs]
    assert [r[0] for r in df.select(age).collect()] == want and want[:3] == [149_999, 149_999, 150_000]
    jobs = df.selectExpr("s AS case_id", "'running' AS status", "s::timestamp AS last_heartbeat_at", "30000L AS heartbeat_deadline_ms", "0 AS n_needs_ocr", "array(0) AS needs_ocr")
    said = {r.case_id: r.execucao for r in cov.status_view(jobs, F.lit("2024-06-01 00:00:00").cast("timestamp")).collect()}
    assert said[signs[0]].endswith("~2 min") and said[signs[2]].endswith("~3 min")


def test_rules_know_ascii_words_alone(spark):
    """As the SQL's expressions and unlike Java's: ß, ø and combining marks end a word."""
    import duckdb

    from evidentia.plans.queries import GENERIC
    from evidentia.rules import first_rule

    texts = ["ein großund text", "straßunder", "ø und", "øund", "x҉und", "der", "nder", "the_and", None, "", "licence", "los und"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(first_rule(F.col("t"), GENERIC.pieces)).collect()]
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{v}'" for v, p in GENERIC.pieces)
    assert got == [duckdb.execute(f"select case {cases} end from (select ?::varchar as t)", [x]).fetchall()[0][0] for x in texts]
    assert got[:5] == ["german", None, "german", "german", "german"]
