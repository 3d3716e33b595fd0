"""DuckDB SQL of the engine's queries."""

from __future__ import annotations

from evidentia.plans.sql import COURT_RULES, QUALITY, SEARCHES, bm25, values

PAGES = r"""pg AS (SELECT 'case-' || (conv_id % 8) AS case_id, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS page, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations),
documents AS (SELECT 'case:' || case_id || ':page:' || page || ':unit:p001' AS doc_id, text, case_id, page FROM pg)"""
RULES = " ".join(f"WHEN regexp_matches(lower(strip_accents(text)), '{chr(92)}b{p}{chr(92)}b') THEN '{v}'" for v, p in COURT_RULES)
LEDGER = f"""{PAGES}, {QUALITY}, led AS (SELECT case_id, page, doc_id AS evidence_id, text, len(r) > 0 OR length(text) < 20 AS bad FROM documents JOIN ql USING (doc_id))"""
SQL: dict[str, str] = {
    "engine_ledger": f"""WITH {LEDGER} SELECT case_id, page, sha256(text) AS page_hash, CASE WHEN bad THEN 'ocr_needed' ELSE 'done' END AS state, CASE WHEN bad THEN 'unknown' {RULES} ELSE 'unknown' END AS piece_type, length(text) AS native_text_chars, evidence_id FROM led""",
    "engine_status": f"WITH {LEDGER} SELECT case_id, count(*) AS total_pages, count(*) FILTER (WHERE bad) AS n_needs_ocr, count(*) FILTER (WHERE bad) AS estimated_pages FROM led GROUP BY case_id",
    "engine_units": f"WITH {PAGES} SELECT case_id, page AS position, doc_id AS evidence_id, sha256(text) AS hash, CASE WHEN text <> '' THEN md5(text) END AS text_md5 FROM documents",
    "engine_search": f"""WITH {PAGES.replace("FROM pg)", "FROM pg WHERE case_id = 'case-1' AND text <> '')")}, {bm25(values([(str(i), q) for i, (_, q) in enumerate(SEARCHES)], "query_id, query"), 10)}
      SELECT query_id, doc_id AS evidence_id, rank, round(score, 6) AS score, split_part(doc_id, ':', 4)::INT AS page FROM lex""",
    "engine_approvals": f"""WITH {LEDGER} SELECT case_id, case_id IN ('case-0', 'case-3') AS approved, count(*) FILTER (WHERE bad) AS estimated_pages, CASE case_id WHEN 'case-0' THEN 5 WHEN 'case-3' THEN 7 END AS max_pages, CASE case_id WHEN 'case-0' THEN 10 WHEN 'case-3' THEN 20 END AS max_calls FROM led GROUP BY case_id""",
    "engine_resumed": f"WITH {LEDGER} SELECT case_id, page FROM led WHERE bad",
}
