"""Schemas of the tables; one set of tables holds all cases."""

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVIDENCE = struct(
    evidence_id=S, case_id=S, page=I, unit_id=S, unit_type=S, start_offset=I, end_offset=I, hash=S, display_ref=S, event_id=S, folio_label=S, source_path=S, text=S,
    image_ref=struct(page_image_path=S, page_pdf_path=S, region_path=S, bbox=T.ArrayType(D)), ocr=struct(provider=S, model=S, reading_confidence=D, warning=S),
)
VECTORS = struct(evidence_id=S, case_id=S, model=S, dim=I, vector=T.ArrayType(T.FloatType()))
#: A row for each distinct term of a unit, one with an empty term for its length,
#: and rows without a term: units (tf) and tokens (dl) that a write added to a case.
POSTINGS = struct(evidence_id=S, case_id=S, term=S, tf=L, dl=L)
LEDGER = struct(
    case_id=S, page=I, page_hash=S, state=S, text_quality_score=D, text_quality_reasons=T.ArrayType(S), native_text_chars=I, native_text_hash=S, piece_type=S, piece_confidence=D,
    ocr_needed=B, ocr_attempts=I, ocr_last_error_kind=S, ocr_last_error_message=S, ocr_yield=S, ocr_prompt_version=I, evidence_ids=T.ArrayType(S), updated_at=TS,
)
JOBS = struct(job_id=S, case_id=S, status=S, area=S, total_pages=I, created_at=TS, updated_at=TS, last_heartbeat_at=TS, heartbeat_deadline_ms=L, lock_owner=S, alerts=T.ArrayType(S))
USAGE = struct(case_id=S, at=TS, tokens_in=L, tokens_out=L)
APPROVALS = struct(case_id=S, estimated_pages=I, approved=B, max_pages=I, max_calls=I, approved_at=TS)
CASES = struct(case_id=S, area=S, source_path=S, source_hash=S, total_pages=I, created_at=TS, updated_at=TS, deleted_at=TS)
FINDINGS = struct(case_id=S, achado_id=S, achado=S, evidence_ids=T.ArrayType(S), registrado_em=TS)
REGISTRY = struct(case_id=S, doc_id=S, titulo=S, ementa=S, tribunal=S, url=S)
DEADLINE = struct(id=S, ato=S, prazo=S, unidade=S, tipo=S, definicao=S, base_legal=S, observacoes=S, revisar=B)
DEADLINE_FILE = struct(versao=S, escopo=S, fontes_curadoria=T.ArrayType(S), prazos=T.ArrayType(DEADLINE))
PHASES = struct(area=S, fase_id=S, fase=S, ordem=I, pecas=T.ArrayType(struct(peca=S, lado=S, base_legal=S)))
CLAIMS = struct(claim_id=S, afirmacao=S, supports=T.ArrayType(struct(evidence_id=S, trecho_base=S)), doc_ids=T.ArrayType(S))
PAGES = struct(case_id=S, page=I, text=S, needs_enrichment=B)
TABLES = {
    "evidence_units": (EVIDENCE, ("evidence_id",)), "evidence_vectors": (VECTORS, ("evidence_id", "model")), "postings": (POSTINGS, ("evidence_id", "term")), "page_ledger": (LEDGER, ("case_id", "page")), "ingest_jobs": (JOBS, ("job_id",)),
    "ocr_usage": (USAGE, ()), "approvals": (APPROVALS, ("case_id",)), "cases": (CASES, ("case_id",)), "findings": (FINDINGS, ("case_id", "achado_id")), "registry": (REGISTRY, ("case_id", "doc_id")),
}
