"""DuckDB SQL of the queries of cases, jobs, panels, bundles and registers."""

from __future__ import annotations

from evidentia.plans.sql import JOBS, LEDGER, RAW, SQL as _BASE, bm25, piece

ITEMS = _BASE["claims_verify"]
PIECE5 = "['inicial', 'contestacao', 'replica', 'sentenca', 'recurso'][o_orderpriority[1]::INT]"
PIECE_NAMES = "CASE t WHEN 'inicial' THEN 'petição inicial' WHEN 'contestacao' THEN 'contestação' WHEN 'replica' THEN 'réplica' WHEN 'sentenca' THEN 'sentença' WHEN 'recurso' THEN 'recurso' END"
VISUAL = "state IN ('ocr_needed', 'skipped_no_key', 'failed_retryable') OR (state = 'ocr_done' AND y = 'stamp_only')"

SQL: dict[str, str] = {
    "ocr_estimates_approved": f"""WITH {LEDGER}, l AS (SELECT case_id, count(*) FILTER (WHERE state IN ('ocr_needed', 'failed_retryable')) AS pending FROM led GROUP BY case_id),
      a AS (SELECT o_orderkey AS case_id, o_orderkey % 3 = 1 AS ap, CASE WHEN o_orderkey % 2 = 0 THEN 10 END AS mp, 40 AS mc FROM orders WHERE o_orderkey % 3 > 0)
      SELECT case_id, pending, pending > 1 AS requires_approval, coalesce(ap, true) AS approved, mp AS max_pages, mc AS max_calls, pending <= 1 OR (coalesce(ap, true) AND mp IS NOT NULL) AS may_run FROM l LEFT JOIN a USING (case_id)""",
    "radar_deadlines": f"""WITH {RAW}, e AS (SELECT *, 'radar-' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY data, event_id)::VARCHAR, 4, '0') AS radar_id FROM rec WHERE tipo = 'purchase'),
      p AS (SELECT '{{"ato":"' || p_name || '","prazo":"' || p_type || '","unidade":"' || p_brand || '","observacoes":"ver"}}' AS j FROM part WHERE p_partkey = 7)
      SELECT case_id, lista, radar_id, 'reu' AS lado_favorecido, CASE lista WHEN 'prazo' THEN 5 ELSE 0 END::BIGINT AS n_ressalvas, CASE lista WHEN 'prazo' THEN (SELECT j FROM p) END AS prazo_referencia FROM e, (VALUES ('prazo'), ('oportunidade')) AS v(lista)""",
    "phase_documents": f"""WITH l AS (SELECT o_custkey AS c, o_orderkey AS page, {PIECE5} AS t FROM orders),
      h AS (SELECT c, bool_or(t = 'recurso') AS rc, bool_or(t = 'sentenca') AS se, bool_or(t = 'replica') AS re, bool_or(t = 'contestacao') AS co, bool_or(t = 'inicial') AS ini FROM l GROUP BY c),
      r AS (SELECT c, CASE WHEN rc AND se THEN 'recursal' WHEN se THEN 'decisoria' WHEN re THEN 'instrucao' WHEN co THEN 'defesa' WHEN ini THEN 'postulatoria' ELSE 'nao-identificavel' END AS f,
        CASE WHEN rc AND se THEN 'recurso' WHEN se THEN 'sentenca' WHEN re THEN 'replica' WHEN co THEN 'contestacao' WHEN ini THEN 'inicial' END AS a FROM h),
      x AS (SELECT r.c, f, max(page) AS hi FROM r LEFT JOIN l ON l.c = r.c AND l.t = r.a GROUP BY r.c, f),
      y AS (SELECT x.*, 'ID ' || o_orderkey AS cit FROM x LEFT JOIN orders ON o_custkey = x.c AND hi BETWEEN o_orderkey - o_orderkey % 100 AND o_orderkey QUALIFY row_number() OVER (PARTITION BY x.c ORDER BY o_orderkey - o_orderkey % 100, o_orderkey::VARCHAR) = 1)
      SELECT c::VARCHAR AS case_id, f AS fase_id, hi AS ancora_ultima, cit AS ancora_citacao FROM y""",
    "case_summary": f"""WITH l AS (SELECT o_custkey AS c, {PIECE5} AS t, min(o_orderkey) AS fst, count(*) AS n FROM orders GROUP BY ALL),
      p AS (SELECT c, string_agg({PIECE_NAMES} || CASE WHEN n > 1 THEN ' (' || n || ' págs.)' ELSE '' END, ', ' ORDER BY fst, t) AS pieces FROM l GROUP BY c),
      e AS (SELECT o_custkey AS c, CASE o_orderkey % 3 WHEN 0 THEN 'citação' ELSE 'sentença' END || ' em ' || coalesce(CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-02' END) AS s, o_orderkey AS k FROM orders WHERE o_orderkey % 3 < 2),
      e4 AS (SELECT c, string_agg(s, '; ' ORDER BY k) AS dated FROM (SELECT * FROM e WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY k) <= 4) GROUP BY c)
      SELECT c_custkey::VARCHAR AS case_id, concat_ws(' ', 'Processo ' || CASE WHEN c_nationkey % 2 = 0 THEN 'penal' ELSE 'cível' END || ' com ' || (c_custkey % 100 + 1) || ' página(s).',
        'Partes identificadas — autor: ' || c_name || '; réu: Empresa ' || c_mktsegment || '.', 'Peças identificadas: ' || pieces || '.', 'Eventos datados: ' || dated || '.', 'Valor da causa: R$ 1.234,' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '.') AS resumo
      FROM customer LEFT JOIN p ON p.c = c_custkey LEFT JOIN e4 ON e4.c = c_custkey""",
    "case_listing": """WITH j AS (SELECT o_custkey AS c, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
      f AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY ALL)
      SELECT c_custkey::VARCHAR AS case_id, CASE WHEN c_nationkey % 2 = 0 THEN 'penal' ELSE 'civil' END AS area, c_name AS autor, 'Empresa ' || c_mktsegment AS reu, status, coalesce(n, 0) AS achados FROM customer LEFT JOIN j ON j.c = c_custkey LEFT JOIN f ON f.c = c_custkey""",
    "case_panels": f"""WITH {LEDGER}, l AS (SELECT case_id, count(*) FILTER (WHERE state IN ('done', 'ocr_done')) AS r, count(*) FILTER (WHERE state = 'ocr_needed') AS o FROM led GROUP BY case_id), g AS (SELECT case_id, count(*) AS n FROM gap GROUP BY case_id),
      dc AS (SELECT l_orderkey AS case_id, l_linenumber AS k, l_quantity::INT AS pages, {piece('l_linenumber - 1')} AS t FROM lineitem), pc AS (SELECT case_id, t, count(*) AS n FROM dc GROUP BY ALL),
      pp AS (SELECT case_id, string_agg(t || ':' || n, '|' ORDER BY n DESC, t) AS pecas, sum(n)::BIGINT AS nd FROM pc GROUP BY case_id),
      pr AS (SELECT case_id, string_agg('ID ' || k, '|' ORDER BY k) AS s FROM (SELECT * FROM dc WHERE t IN ('inicial', 'contestacao', 'sentenca') OR pages >= 20 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY k) <= 5) GROUP BY case_id),
      f AS (SELECT l_orderkey AS case_id, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL)
      SELECT c.case_id, NULL::VARCHAR AS autor, o_orderpriority AS reu, coalesce(r, 0) AS pages_read, coalesce(o, 0) AS n_ocr_needed, coalesce(g.n, 0) AS n_gaps, pecas, nd AS n_documentos, s AS principais, coalesce(f.n, 0) AS achados
      FROM cases c JOIN orders ON o_orderkey = c.case_id LEFT JOIN l ON l.case_id = c.case_id LEFT JOIN g ON g.case_id = c.case_id LEFT JOIN pp ON pp.case_id = c.case_id LEFT JOIN pr ON pr.case_id = c.case_id LEFT JOIN f ON f.case_id = c.case_id""",
    "final_job_status": f"""WITH {LEDGER}, n AS (SELECT case_id, count(*) AS r, count(*) FILTER (WHERE page = 5) AS pen, count(*) FILTER (WHERE state IN ('ocr_needed', 'failed_retryable')) AS pending FROM led GROUP BY case_id),
      x AS (SELECT cases.case_id, case_id % 7 + 1 AS total, case_id % 2 = 0 AS penal, coalesce(r, 0) AS r, coalesce(pen, 0) AS pen, coalesce(pending, 0) AS pending FROM cases LEFT JOIN n USING (case_id))
      SELECT case_id, CASE WHEN r < total THEN 'error' WHEN pending > 2 THEN 'paused_awaiting_ocr_approval' ELSE 'done' END AS final_status,
      array_to_string(list_filter([CASE WHEN r < total THEN 'ingest_incomplete' END, CASE WHEN pending > 0 THEN 'ocr_pending' END, CASE WHEN NOT penal AND pen > 0 THEN 'area_mismatch' END], lambda a: a IS NOT NULL), ',') AS alerts FROM x""",
    "references_verdict": f"""WITH c AS ({ITEMS}), e AS (SELECT DISTINCT (vec_id * 3)::VARCHAR AS i FROM embeddings ANTI JOIN documents ON doc_id = vec_id * 3), d AS (SELECT DISTINCT 'd' || (user_id % 7) AS i FROM events WHERE 'd' || (user_id % 7) NOT IN ('d0', 'd1', 'd5')),
      v AS (SELECT claim_id AS i FROM c WHERE status <> 'ok' AND NOT (status = 'doc_id_nao_registrado' AND list_has_all(['d0', 'd1', 'd5'], string_split(missing_docs, '|')))),
      o AS (SELECT 'evidence' AS kind, i AS id FROM e UNION ALL SELECT 'doc', i FROM d UNION ALL SELECT 'claim', i FROM v)
      SELECT kind, id FROM o UNION ALL SELECT 'verdict', CASE WHEN count(*) = 0 THEN 'ok' ELSE count(*) FILTER (WHERE kind = 'evidence') || '/' || count(*) FILTER (WHERE kind = 'doc') || '/' || count(*) FILTER (WHERE kind = 'claim') END FROM o""",
    "vector_upsert": """WITH n AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0)
      SELECT vec_id, 'a' AS model, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.vec_id = e.vec_id AND n.model = 'a') UNION ALL SELECT vec_id, model, label FROM n""",
    "dossier_limits": """WITH b AS (SELECT CASE WHEN length(trim(text)) > 600 THEN substr(trim(text), 1, 600) || ' …' ELSE trim(text) END AS a, doc_id::VARCHAR AS e FROM documents), x AS (SELECT DISTINCT 'ach-' || substr(sha256(a || '|' || e), 1, 12) AS i, length(a) AS n FROM b WHERE length(a) > 0)
      SELECT 'c' AS case_id, i AS achado_id, n AS n_chars FROM x QUALIFY row_number() OVER (ORDER BY i) <= 470 UNION ALL SELECT 'c', 'old-' || i, 1 FROM generate_series(0, 29) g(i)""",
    "rejected_findings": """WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), b AS (SELECT (item_id % 3)::VARCHAR AS case_id, item_id, (item_id * 7919 % (n * 2)) AS e, e < n AS known FROM benchmark, n),
      p AS (SELECT case_id, CASE WHEN item_id % 7 = 0 THEN 'empty' WHEN item_id % 5 = 0 THEN 'no evidence' WHEN known THEN 'unknown: zz' ELSE 'unknown: ' || e || ', zz' END AS problem FROM b) SELECT case_id, problem, count(*) AS n FROM p GROUP BY ALL""",
    "display_refs": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ref' WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN o_orderpriority || ', fl. ' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'fl. ' || o_orderkey
      WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'pagina ' || o_orderkey || ' do PDF' END AS ref FROM orders""",
    "visual_pages": f"WITH {LEDGER} SELECT case_id, page FROM led ANTI JOIN (SELECT * FROM lineitem WHERE l_tax > 0.04) x ON l_orderkey = case_id AND l_linenumber = page WHERE {VISUAL}",
    "textual_units": f"""WITH {LEDGER}, v AS (SELECT DISTINCT case_id, page FROM led WHERE {VISUAL})
      SELECT led.case_id || '-' || led.page AS evidence_id FROM led ANTI JOIN v ON v.case_id = led.case_id AND v.page = led.page ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45 AND l_linenumber % 2 = 0) x ON l_orderkey = led.case_id AND l_linenumber = led.page WHERE chars > 0""",
    "ledger_evidence": """WITH a AS (SELECT o_custkey % 100 AS case_id, o_orderkey AS page, unnest([(1, 'u' || (o_orderkey % 700)), (2, 'u' || o_custkey)]) AS x FROM orders), b AS (SELECT case_id, x[2] AS e, min((page, x[1])) AS fst FROM a GROUP BY ALL)
      SELECT case_id, position, e AS evidence_id, c_name AS text FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fst) AS position FROM b) JOIN customer ON 'u' || c_custkey = e""",
    "interrupted_jobs": f"WITH {JOBS} SELECT case_id::VARCHAR AS case_id, job_id, status FROM jobs WHERE case_id % 9 <> 0 AND (status = 'error' OR (status IN ('running', 'queued') AND epoch_ms(TIMESTAMP '2024-01-20') - epoch_ms(ts) > 120000))",
    "stamp_requeue": f"WITH {LEDGER} SELECT case_id, page, CASE WHEN state = 'ocr_done' AND y = 'stamp_only' AND page % 3 < 2 THEN 'ocr_needed' ELSE state END AS state, CASE WHEN state = 'ocr_done' AND page % 3 < 2 THEN 2 ELSE page % 3 END::INT AS ocr_prompt_version FROM led",
    "token_usage": "SELECT user_id AS case_id, sum(event_id)::BIGINT AS tokens_in, sum(event_id % 100)::BIGINT AS tokens_out FROM events GROUP BY 1",
    "pending_notes": """WITH p AS (SELECT o_custkey % 200 AS case_id, coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0)), []) AS p FROM orders GROUP BY 1)
      SELECT case_id, array_to_string(CASE WHEN len(p) > 20 THEN p[1:10] ELSE p END, ',') AS pages, CASE WHEN len(p) > 20 THEN len(p) || ' páginas escaneadas aguardando leitura (págs. ' || p[1] || '–' || p[-1] || ' do PDF); mostrando as 10 primeiras.' END AS note FROM p""",
    "first_hits": "WITH h AS (SELECT user_id AS query_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS alt, event_id FROM events) SELECT query_id, alt, event_id FROM h QUALIFY alt = min(alt) OVER (PARTITION BY query_id)",
    "matrix_gaps": """WITH a AS (SELECT n_name AS topic, n_nationkey % 3 AS k FROM nation)
      SELECT 'all' AS present, topic, 'Sem ocorrência do tema na petição inicial.' AS gap FROM a WHERE k <> 0 UNION ALL SELECT 'all', topic, 'Sem ocorrência do tema na contestação — candidato a fato sem impugnação específica (confirme lendo a peça).' FROM a WHERE k <> 1
      UNION ALL SELECT 'one side', topic, 'Sem ocorrência do tema na petição inicial.' FROM a WHERE k <> 0 UNION ALL SELECT 'one side', topic, 'Contestação não identificada no caderno.' FROM a""",
    "evidence_bundles": """WITH d AS (SELECT doc_id, source, text, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE source IS NOT NULL), st AS (SELECT source, count(*) AS n, avg(len(t)) AS a FROM d GROUP BY source),
      tf AS (SELECT source, doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (VALUES ('the'), ('licensed')) v(term) WHERE list_contains(t, term)), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT tf.source, doc_id, round(-sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score, count(*) = 2 AS al FROM tf JOIN df ON df.source = tf.source AND df.term = tf.term JOIN st ON st.source = tf.source GROUP BY ALL),
      pk AS (SELECT *, max(al) OVER (PARTITION BY source) AS anyall FROM sc), h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) AS rank FROM pk WHERE al OR NOT anyall QUALIFY rank <= 4),
      f AS (SELECT h.source, string_agg(h.doc_id || ':' || least(240, length(text)) || ':' || least(500, length(text)), '|' ORDER BY rank) AS fatos, string_agg(h.doc_id::VARCHAR, ',' ORDER BY rank) AS ids FROM h JOIN documents ON documents.doc_id = h.doc_id GROUP BY h.source),
      p AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS provas FROM documents WHERE n_chars < 60 GROUP BY source)
      SELECT st.source AS case_id, fatos, provas, 'tese c|tese b|tese a' AS teses, 1::BIGINT AS lacunas, ids AS fundamento FROM st LEFT JOIN f ON f.source = st.source LEFT JOIN p ON p.source = st.source""",
    "enrich_outcomes": """WITH q AS (SELECT o_custkey % 50 AS k, o_orderkey AS page, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0),
      c AS (SELECT k, page, CASE WHEN k % 2 = 0 THEN 50 ELSE 1000000000 END AS calls, CASE page % 7 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS needs FROM q WHERE k % 3 <> 0 OR n <= 40),
      r1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY page) <= calls),
      s1 AS (SELECT k, count(*) AS spent FROM r1 GROUP BY k),
      r2 AS (SELECT c.* FROM c JOIN s1 USING (k) LEFT JOIN r1 USING (k, page) WHERE r1.page IS NULL OR c.needs > 1 QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY c.page) <= c.calls - s1.spent),
      t2 AS (SELECT k, page, (r1.p IS NOT NULL)::INT + (r2.p IS NOT NULL)::INT AS tries, needs, calls FROM c LEFT JOIN (SELECT k, page, page AS p FROM r1) r1 USING (k, page) LEFT JOIN (SELECT k, page, page AS p FROM r2) r2 USING (k, page)),
      s2 AS (SELECT k, sum(tries) AS spent FROM t2 GROUP BY k),
      r3 AS (SELECT t2.k, t2.page FROM t2 JOIN s2 USING (k) WHERE tries < needs QUALIFY row_number() OVER (PARTITION BY t2.k ORDER BY t2.page) <= calls - spent),
      o AS (SELECT t2.k, t2.page, tries + (r3.page IS NOT NULL)::INT AS attempts, needs FROM t2 LEFT JOIN r3 ON r3.k = t2.k AND r3.page = t2.page)
      SELECT k::VARCHAR AS case_id, page, attempts, CASE WHEN attempts >= needs THEN 'ocr_done' WHEN page % 7 = 1 AND attempts = 3 THEN 'failed_permanent' ELSE 'failed_retryable' END AS state,
        CASE page % 7 WHEN 0 THEN 0 WHEN 2 THEN 10 * (attempts - 1) ELSE 10 * attempts END AS tokens_in, CASE page % 7 WHEN 0 THEN 0 WHEN 2 THEN attempts * (attempts + 1) // 2 - 1 ELSE attempts * (attempts + 1) // 2 END AS tokens_out,
        CASE WHEN attempts < needs THEN CASE WHEN page % 7 IN (0, 2) THEN 'TimeoutError' ELSE 'empty' END END AS error
      FROM o WHERE attempts > 0""",
    "archive_pages": r"""WITH x AS (SELECT 'case-' || (conv_id % 20) AS case_id, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS page, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM conversations)
      SELECT case_id, page, md5(s) AS text_md5, length(s) < 20 AS needs_enrichment FROM x WHERE page % 3 = 0""",
    "role_pieces": f"""WITH x AS (SELECT o_custkey % 20 AS case_id, o_orderkey AS k, {piece('o_orderkey')} AS t FROM orders), r AS (SELECT case_id, k, CASE WHEN t IN ('inicial', 'contestacao') THEN t ELSE 'atos_judiciais' END AS role FROM x WHERE t IN ('inicial', 'contestacao', 'sentenca'))
      SELECT case_id, role, row_number() OVER (PARTITION BY case_id, role ORDER BY k) AS position, k::VARCHAR AS num, (k * 3) || '-' || (k * 3 + 1) AS paginas, 'ID ' || k AS citacao FROM r""",
    "proof_pages": "SELECT source AS case_id, doc_id AS page, CASE WHEN doc_id % 4 > 0 THEN 'e' || doc_id END AS evidence_id, 'pagina ' || doc_id AS display_ref FROM documents WHERE n_chars < 400",
    "outside_queries": "SELECT c_custkey, 'cobranca contra [parte] dano moral' AS query FROM customer",
    "json_lists": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ',b' ELSE '' END AS items FROM events",
    "file_names": r"""WITH x AS (SELECT page_id, substr(regexp_replace(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s FROM pages)
      SELECT page_id, 'page-' || lpad(page_id::VARCHAR, 6, '0') AS page_file, CASE WHEN s <> '' THEN s ELSE 'documento' END AS file_slug FROM x""",
    "valid_dates": "SELECT o_orderkey, try_cast(strftime(o_orderdate, '%Y-%m-') || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS valid FROM orders",
    "retrieval_texts": "SELECT doc_id, md5('title: none | text: ' || substr(text, 1, 6000)) AS text_md5, 29 + least(6000, length(text)) AS n_query FROM documents",
    "page_roles": f"""WITH x AS (SELECT o_custkey % 20 AS case_id, o_orderkey * 3 + o_orderkey % 3 AS page, CASE WHEN o_orderkey % 3 < 2 THEN {piece('o_orderkey')} END AS t FROM orders) SELECT case_id, page, CASE WHEN t IN ('inicial', 'contestacao') THEN t WHEN t = 'sentenca' THEN 'atos_judiciais' ELSE 'fontes_primarias' END AS role FROM x""",
    "head_pages": "WITH u AS (SELECT conv_id % 50 AS case_id, conv_id * 100 + turn AS page FROM conversations WHERE turn % 2 = 0 AND length(text) > 0) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY page) <= 10",
    "radar_lists": f"""WITH {RAW}, e AS (SELECT case_id, 'radar-' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY data, event_id)::VARCHAR, 4, '0') AS r FROM rec WHERE tipo = 'purchase'),
      x AS (SELECT case_id, lista || ':' || r AS s, o, r FROM e, (VALUES (0, 'prazo'), (1, 'oportunidade')) v(o, lista)), y AS (SELECT case_id, list(s ORDER BY o, r) AS l FROM x GROUP BY case_id) SELECT case_id, len(l) AS n, md5(array_to_string(l, '|')) AS items_md5 FROM y""",
    "result_json": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS result FROM nation""",
}
