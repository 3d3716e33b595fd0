"""The same queries in DuckDB SQL, written from the semantics."""

from __future__ import annotations

SEARCHES = (
    ("q1", "the of that"),
    ("q2", "der und zzzabsent"),
    ("q3", "la de en"),
    ("q4", "licensed under apache"),
    ("q5", "Et TREÊAUX éaux et"),
    ("q6", "!!!"),
    ("q7", "zzzabsent"),
)
TOPICS = (("t1", 0, "licensed under"), ("t1", 1, "apache license"), ("t2", 0, "und der"), ("t3", 0, "la de"))

TOK = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"


def tok(c: str) -> str:
    return TOK.format(c)


def values(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {cells}) AS v({names}))"


def bm25(queries: str, k: int) -> str:
    """CTEs q, qt, shape, d, st, tf, df, sc and lex (query_id, doc_id, mode, score, rank)."""
    return f"""
q AS {queries},
qtok AS (SELECT query_id, unnest({tok('query')}) AS term FROM q),
qt AS (SELECT query_id, term, count(*) AS qf FROM qtok GROUP BY ALL),
shape AS (SELECT query_id, count(*) AS n_terms, sum(qf) AS n_tokens FROM qt GROUP BY query_id),
d AS (SELECT doc_id, {tok('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(-sum(qf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score, count(*) AS matched FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
pick AS (SELECT *, matched = n_terms AS al, max(matched = n_terms) OVER (PARTITION BY query_id) AS any_all FROM sc JOIN shape USING (query_id)),
lex AS (SELECT query_id, doc_id, CASE WHEN al THEN 'and' ELSE 'or' END AS mode, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank
  FROM pick WHERE al OR (NOT any_all AND n_tokens >= 2) QUALIFY rank <= {k})"""


SEARCH = values(SEARCHES, "query_id, query")
NORM = """nv AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)"""
SEM = f"""{NORM}, qv AS (SELECT query_id, v AS q FROM q JOIN nv ON vec_id = regexp_extract(query_id, '([0-9]+)', 1)::BIGINT),
sem AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(q, v), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(q, v), 9) DESC, vec_id) AS rank FROM qv, nv QUALIFY rank <= 10)"""
FUSED = """fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(src) AS s, min(CASE WHEN src = 0 THEN rank END) AS lexical_rank, min(CASE WHEN src = 1 THEN rank END) AS semantic_rank
  FROM (SELECT query_id, doc_id, rank, 0 AS src FROM lex UNION ALL SELECT query_id, doc_id, rank, 1 FROM sem) GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s, CASE WHEN s = 0 THEN lexical_rank ELSE semantic_rank END) AS rank FROM fu QUALIFY rank <= 10)"""

QUALITY = r"""
n0 AS (SELECT doc_id, coalesce(text, '') AS raw, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
n1 AS (SELECT doc_id, raw, t, length(t) AS n, greatest(length(t), 1) AS total, len(regexp_extract_all(t, '[\p{L}\p{N}]')) AS useful,
  len(regexp_extract_all(raw, '\\u(?:FFFD|0000|0001)|[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]')) AS control, len(regexp_extract_all(t, '\s')) AS spaces,
  list_filter(string_split(t, ' '), lambda x: length(x) >= 45) AS lt, len(regexp_extract_all(t, '[^\p{L}\p{N}\s.,;:()/%-]')) AS sym FROM n0),
n2 AS (SELECT *, coalesce(list_sum(list_transform(lt, lambda x: length(x))), 0) AS lc FROM n1),
ql AS (SELECT doc_id, list_filter([CASE WHEN useful < 20 THEN 'too_few_useful_chars' END, CASE WHEN useful / total < 0.45 THEN 'low_alnum_density' END,
  CASE WHEN n > 20 AND spaces / total < 0.04 THEN 'low_space_ratio' END, CASE WHEN lc / total > 0.3 OR (len(lt) > 0 AND useful < 200) THEN 'long_unseparated_sequence' END,
  CASE WHEN (sym + control) / total > 0.15 OR control >= 2 THEN 'gibberish_ratio_high' END], lambda x: x IS NOT NULL) AS r FROM n2)"""

#: Stamps of the source systems, written here on their own; this
#: dialect has Unicode rules without a flag.
STAMPS = (
    r"(?i)num\.\s*\d+\s*-\s*p[áa]g\.\s*\d+",
    r"(?:Documento\s+)?[Aa]ssinado eletronicamente por:?\s*.{0,80}?\d{2}/\d{2}/\d{4}(?:,?\s*(?:[àa]s\s*)?\d{2}:\d{2}(?::\d{2})?)?(?:\s*-\s*[0-9a-f]{4,12})?",
    r"(?i)este documento foi gerado pelo usu[áa]rio\s*[\d.*-]{0,24}(?:\s*em\s*\d{2}/\d{2}/\d{4}(?:\s*\d{2}:\d{2}(?::\d{2})?)?)?",
    r"(?i)n[úu]mero do (?:documento|processo):?\s*[\d.\-]+",
    r"https?://\S+",
    r"(?i)fls\.?\s*:?\s*\d+",
)
#: Numbers and addresses of persons.
MASKS = (
    (r"[0-9]{7}-?[0-9]{2}\.?[0-9]{4}\.?[0-9]\.?[0-9]{2}\.?[0-9]{4}", "[processo]"),
    (r"[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}", "[cnpj]"),
    (r"[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}", "[cpf]"),
    (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.-]+", "[email]"),
)


def replaced(c: str, pairs) -> str:
    for pattern, by in pairs:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


def stripped(c: str) -> str:
    return replaced(c, [(p, " ") for p in STAMPS])


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def masked(c: str, name: bool) -> str:
    c = replaced(c, MASKS)
    if name:
        c = f"regexp_replace({c}, '(?i)licensed under', '[parte]', 'g')"
    return f"trim(regexp_replace({c}, '\\s{{2,}}', ' ', 'g'))"


#: What court pages and their terms are known by, on folded text.
COURT_RULES = (
    ("denuncia", "denuncia"), ("resposta_acusacao", "resposta a acusacao"), ("alegacoes_finais", "(alegacoes finais|memoriais)"), ("laudo", "laudo (pericial|de exame|toxicologico|cadaverico|necroscopico)"),
    ("inicial", "(peticao inicial|inicial)"), ("replica", "(replica|impugnacao a contestacao)"), ("contestacao", "contestacao"), ("sentenca", "sentenca"), ("decisao", "(decisao|despacho)"),
    ("recurso", "(apelacao|agravo|recurso)"), ("comprovante", "(comprovante|recibo|boleto|pix|pagamento)"), ("procuracao", "procuracao"), ("documento_pessoal", "(rg|cpf|cnh|documento de identidade)"),
)
COURT_CONCEPTS = (
    "pagamento", "cobranca", "prescricao", "dano moral", "dano material", "multa contratual", "juros de mora", "citacao", "contestacao", "negativacao", "consumidor", "rescisao", "inadimplemento", "indenizacao",
    "repeticao de indebito", "tutela de urgencia", "honorarios", "revelia", "comprovante",
)
COURT_CRITICAL = ("inicial", "contestacao", "replica", "decisao", "sentenca", "recurso", "denuncia", "resposta_acusacao", "alegacoes_finais", "laudo")
COURT_HEADS = (
    "peticao inicial do autor", "replica ao reu", "impugnacao a contestacao", "contestacao do banco", "sentenca de merito", "despacho do juiz", "agravo de instrumento", "recibo e pix", "procuracao ad judicia",
    "copia do rg e cpf", "denuncia do ministerio publico", "resposta a acusacao", "memoriais da defesa", "laudo pericial contabil", "folha sem titulo", "decisao e sentenca",
)
COURT_TERMS = ("cobranca e prescricao do pagamento", "dano moral com juros de mora", "tutela de urgencia e repeticao de indebito", "nada a registrar", "negativacao do consumidor, honorarios", "rescisao por inadimplemento, indenizacao")


def quoted(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


PIECES = ("inicial", "contestacao", "comprovante", "sentenca", "unknown")


def piece(n: str) -> str:
    return f"[{', '.join(repr(p) for p in PIECES)}][({n}) % 5 + 1]"


STAMPED = """
sp AS (SELECT (conv_id % 10)::VARCHAR AS case_id, conv_id, turn, role, conv_id * 100 + turn AS page, conv_id % 10 AS k,
  CASE WHEN k <= 5 THEN 'pje' WHEN k <= 7 THEN 'eproc' WHEN k = 8 THEN 'estj' ELSE 'desconhecido' END AS kind,
  CASE WHEN k <= 7 THEN true WHEN k = 8 THEN turn % 3 <> 0 ELSE false END AS hit FROM conversations),
sysn AS (SELECT case_id, any_value(kind) AS kind, count(*) AS n_pages, count(*) FILTER (WHERE hit) AS m FROM sp GROUP BY case_id),
sys AS (SELECT case_id, n_pages, CASE WHEN kind = 'pje' AND m > 0 THEN 'pje' WHEN kind = 'eproc' AND m >= 3 AND m >= n_pages * 0.3 THEN 'eproc' WHEN kind = 'estj' AND m >= 3 AND m >= n_pages * 0.2 THEN 'estj' ELSE 'desconhecido' END AS sistema, m FROM sysn),
dmap0 AS (SELECT case_id, sistema, CASE WHEN sistema = 'pje' THEN conv_id::VARCHAR ELSE (conv_id % 1000)::VARCHAR || ':PET1' END AS num, min(page) AS first_page, max(page) AS last_page, count(*) AS pages,
  CASE WHEN sistema = 'pje' THEN min('2024-05-0' || (conv_id % 9 + 1)) FILTER (WHERE turn % 2 = 1) END AS signed_date,
  CASE WHEN sistema = 'pje' THEN arg_min(role, page) FILTER (WHERE turn % 2 = 1) END AS signer, arg_min(PIECE, page) AS piece_type, any_value(conv_id % 1000) AS evento
  FROM sp JOIN sys USING (case_id) WHERE sistema IN ('pje', 'eproc') GROUP BY ALL),
dmap AS (SELECT *, CASE WHEN sistema = 'pje' THEN 'ID ' || num ELSE 'Evento ' || evento || ', PET1' END AS citacao FROM dmap0)""".replace("PIECE,", piece("conv_id") + ",")
# `piece` and `evento` are aggregated; the grouping is by case, system and number
STAMPED = STAMPED.replace("GROUP BY ALL),\ndmap AS", "GROUP BY case_id, sistema, 3),\ndmap AS")

LEDGER = f"""
cases AS (SELECT o_orderkey AS case_id, 7 AS total_pages FROM orders),
led AS (SELECT l_orderkey AS case_id, l_linenumber AS page, CASE WHEN l_returnflag = 'R' THEN 'ocr_needed' WHEN l_returnflag = 'A' THEN 'done' WHEN l_linestatus = 'O' THEN 'ocr_done' ELSE 'failed_retryable' END AS state,
  {piece('l_linenumber - 1')} AS piece_type, CASE WHEN l_quantity < 5 THEN 0 ELSE l_quantity::INT END AS chars, CASE WHEN l_discount = 0 THEN 'stamp_only' ELSE 'content' END AS y, sha256(l_partkey::VARCHAR) AS h FROM lineitem),
miss AS (SELECT case_id, p AS page FROM (SELECT case_id, unnest(generate_series(1, total_pages)) AS p FROM cases) ANTI JOIN led ON led.case_id = _d.case_id AND led.page = _d.p),
gap AS (SELECT case_id, 'critical_piece_incomplete' AS kind, piece_type, count(*) AS n_pages, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM led WHERE state = 'ocr_needed' AND piece_type IN ('inicial', 'contestacao', 'sentenca') GROUP BY ALL
  UNION ALL SELECT case_id, 'unknown_unread_potentially_critical', 'unknown', count(*), string_agg(page::VARCHAR, ',' ORDER BY page) FROM led WHERE piece_type = 'unknown' AND chars = 0 AND state = 'ocr_needed' GROUP BY case_id
  UNION ALL SELECT case_id, 'ingest_incomplete', 'unknown', count(*), min(page) || ',' || max(page) FROM miss GROUP BY case_id)""".replace(
    "FROM (SELECT case_id, unnest(generate_series(1, total_pages)) AS p FROM cases) ANTI JOIN led ON led.case_id = _d.case_id AND led.page = _d.p",
    "FROM (SELECT case_id, unnest(generate_series(1, total_pages)) AS p FROM cases) g ANTI JOIN led ON led.case_id = g.case_id AND led.page = g.p",
)

RAW = """
raw AS (SELECT (user_id % 50)::VARCHAR AS case_id, lpad(event_id::VARCHAR, 12, '0') AS rid, event_type AS tipo, CASE WHEN value > 50 THEN 'alto' END AS modalidade, strftime(ts, '%Y-%m-%d') AS data,
  event_id % 40 + 1 AS page, 'case:' || (user_id % 50) || ':page:' || (event_id % 40 + 1) || ':unit:p001' AS eid, CASE WHEN event_id % 4 = 0 THEN 0.75 ELSE 0.95 END AS rc FROM events),
amb AS (SELECT case_id, tipo, coalesce(modalidade, '') AS m, page, count(DISTINCT data) > 1 AS a FROM raw GROUP BY ALL),
grp AS (SELECT case_id, tipo, modalidade, data, arg_min(page, rid) AS fp, count(DISTINCT eid) AS n_evidence, arg_min(eid, page) AS canonical, string_agg(DISTINCT eid, ',' ORDER BY eid) AS ids0,
  list_sort(list(DISTINCT page)) AS pgs, min(rc) AS reading_confidence FROM raw GROUP BY case_id, tipo, modalidade, data),
rec AS (SELECT grp.*, array_to_string(list_transform(pgs, lambda x: 'case:' || grp.case_id || ':page:' || x || ':unit:p001'), ',') AS evidence_ids, 'evento ' || grp.tipo AS descricao, a,
  'evt-' || substr(sha256(concat_ws('|', grp.case_id, grp.tipo, 'unknown', coalesce(grp.modalidade, 'unknown'), data, pgs[1], substr(sha256(canonical || '|' || 'evento ' || grp.tipo), 1, 12))), 1, 12) AS event_id
  FROM grp JOIN amb ON amb.case_id = grp.case_id AND amb.tipo = grp.tipo AND amb.m = coalesce(grp.modalidade, '') AND amb.page = grp.fp)"""

JOBS = """
jobs AS (SELECT user_id AS case_id, event_id AS job_id, ts, ['queued', 'running', 'error', 'done', 'paused_awaiting_ocr_approval'][event_id % 5 + 1] AS status, (event_id % 13)::INT AS total_pages FROM events),
last AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, job_id DESC) = 1)"""


def cost(n: str) -> str:
    return f"'R$ ' || replace(printf('%.2f', {n} * 0.02), '.', ',') || ' a R$ ' || replace(printf('%.2f', {n} * 0.05), '.', ',')"


GEN = (("license", r"\blicen[sc]e"), ("german", r"\b(und|der)\b"), ("french", r"\b(les|est)\b"), ("spanish", r"\b(los|una)\b"), ("english", r"\b(the|and)\b"))

SQL: dict[str, str] = {
    "bm25_or_fallback": f"WITH {bm25(SEARCH, 10)} SELECT query_id, doc_id, mode, rank, round(score, 6) AS score FROM lex",
    "stored_index_search": f"""WITH d AS (SELECT doc_id, source, {tok("CASE WHEN doc_id % 3 = 1 THEN upper(text) ELSE text END")} AS t FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
      st AS (SELECT source, count(*) AS n, avg(len(t)) AS a FROM d GROUP BY source), s AS {SEARCH},
      qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tok('query')}) AS term FROM s) GROUP BY ALL), shape AS (SELECT query_id, count(*) AS n_terms, sum(qf) AS n_tokens FROM qt GROUP BY query_id),
      tf AS (SELECT source, doc_id, dl, term, count(*) AS tf FROM (SELECT source, doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
      df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT source, query_id, doc_id, round(-sum(qf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score, count(*) AS matched
        FROM tf JOIN qt USING (term) JOIN df USING (source, term) JOIN st USING (source) GROUP BY ALL),
      pick AS (SELECT *, matched = n_terms AS al, max(matched = n_terms) OVER (PARTITION BY source, query_id) AS any_all FROM sc JOIN shape USING (query_id))
      SELECT source || '/' || query_id AS query_id, doc_id, CASE WHEN al THEN 'and' ELSE 'or' END AS mode, row_number() OVER (PARTITION BY source, query_id ORDER BY score, doc_id::VARCHAR) AS rank, round(score, 6) AS score
      FROM pick WHERE al OR (NOT any_all AND n_tokens >= 2) QUALIFY rank <= 3""",
    "bm25_and": f"WITH {bm25(SEARCH, 25)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM lex WHERE mode = 'and'",
    "term_stats": f"WITH p AS (SELECT doc_id, unnest({tok('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM p GROUP BY ALL) SELECT term, count(*) AS df, sum(n)::BIGINT AS cf FROM tf GROUP BY term",
    "vector_topk": f"""WITH {NORM} SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS rank, round(list_inner_product(a.v, b.v), 6) AS score
      FROM nv a, nv b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10""",
    "rrf_fusion": f"WITH {bm25(SEARCH, 10)}, {SEM}, {FUSED} SELECT query_id, doc_id, rank, round(score, 9) AS score, lexical_rank, semantic_rank FROM fused",
    "hybrid_search": f"""WITH {bm25(SEARCH, 10)}, {SEM}, {FUSED}, x AS (SELECT doc_id, {collapsed(stripped('text'))} AS a, {collapsed('text')} AS b FROM documents WHERE doc_id IN (SELECT doc_id FROM fused)),
      y AS (SELECT doc_id, CASE WHEN length(a) >= 40 THEN a ELSE b END AS e FROM x)
      SELECT query_id, rank, doc_id, round(score, 9) AS score, 'hybrid' AS mode, CASE WHEN length(e) > 240 THEN substr(e, 1, 240) || ' …' WHEN e <> '' THEN e END AS excerpt FROM fused JOIN y USING (doc_id)""",
    "snippet_topk": f"""WITH {bm25(SEARCH, 5)},
      h AS (SELECT query_id, lex.doc_id, rank, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS tk, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS sep, {tok('text')} AS f FROM lex JOIN documents ON documents.doc_id = lex.doc_id),
      w AS (SELECT query_id, list(term) AS want FROM qt GROUP BY query_id),
      g AS (SELECT h.*, want, list_transform(f, lambda x: list_contains(want, x)) AS hit, len(f) AS n FROM h JOIN w USING (query_id)),
      places AS (SELECT query_id, doc_id, unnest(generate_series(1, n)) AS i, f, hit, want FROM g),
      c AS (SELECT query_id, doc_id, i, len(list_distinct(list_filter(f[i:i + 23], lambda x: list_contains(want, x)))) AS m FROM places WHERE hit[i]),
      s AS (SELECT query_id, doc_id, arg_min(i, (-m, i)) AS i FROM c GROUP BY ALL),
      b AS (SELECT g.*, greatest(0, least(i - 1, n - 24)) AS a FROM g JOIN s USING (query_id, doc_id)),
      y AS (SELECT *, least(n, a + 24) AS z FROM b)
      SELECT query_id, doc_id, rank, CASE WHEN a > 0 THEN '… ' ELSE sep[1] END || array_to_string(list_transform(generate_series(a + 1, z), lambda j: CASE WHEN j > a + 1 THEN sep[j] ELSE '' END || CASE WHEN hit[j] THEN '«' || tk[j] || '»' ELSE tk[j] END), '')
        || CASE WHEN z = n THEN sep[n + 1] ELSE ' … ' END AS snippet FROM y""",
    "html_page_source": f"""WITH h AS (SELECT page_id, {replaced('html', [(f"(?is)<{x}\\b.*?</{x}\\s*>", " ") for x in ("script", "style", "noscript")] + [("(?s)<!--.*?-->", " "), ("(?s)<[^>]*>", " ")])} AS s FROM pages),
      e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS s FROM h), c AS (SELECT page_id, {collapsed('s')} AS s FROM e)
      SELECT page_id, length(s) AS n_chars, md5(s) AS text_md5, length(s) < 20 AS needs_enrichment FROM c""",
    "missing_vectors": "SELECT doc_id, source FROM documents ANTI JOIN embeddings ON doc_id = vec_id WHERE trim(coalesce(text, '')) <> ''",
    "text_quality": f"WITH {QUALITY} SELECT doc_id, greatest(0.0::DOUBLE, round(1.0::DOUBLE - len(r) * 0.22::DOUBLE, 2)) AS score, len(r) > 0 AS needs_ocr, array_to_string(r, ',') AS reasons FROM ql",
    "quality_confusion": f"WITH {QUALITY} SELECT count(*) FILTER (WHERE len(r) > 0 AND quality = 0) AS tp, count(*) FILTER (WHERE len(r) = 0 AND quality <> 0) AS tn, count(*) FILTER (WHERE len(r) > 0 AND quality <> 0) AS fp, count(*) FILTER (WHERE len(r) = 0 AND quality = 0) AS fn FROM ql JOIN labels USING (doc_id)",
    "ocr_yield": f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE text || ' Num. ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' - Pág. 3 https://pje.example/x?y Fls. 12' ELSE ' - Pág. 3 HTTPS://PJE.example/x?y Fls. 12' END END AS s FROM documents), x AS (SELECT doc_id, coalesce(s, '') AS s, {stripped("coalesce(s, '')")} AS c FROM s)
      SELECT doc_id, CASE WHEN c <> s AND len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]')) < 120 THEN 'stamp_only' ELSE 'content' END AS ocr_yield, len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]')) AS useful FROM x""",
    "pii_strip": f"SELECT doc_id, md5({masked('text', True)}) AS stripped_md5, len(regexp_extract_all({masked('text', False)}, '\\[(cpf|cnpj|email|processo)\\]')) AS masks FROM documents",
    "secret_redact": r"""SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text || ' https://x.example/a?key=abc' || doc_id || '&z=1 AIzaSyA0123456789_abcdefghijk s3cretvalue', 'AIza[0-9A-Za-z_-]{20,}', '[REDACTED]', 'g'),
      '([?&][kK][eE][yY]=)[^&\s"'']+', '\1[REDACTED]', 'g'), 's3cretvalue', '[REDACTED]')) AS redacted_md5 FROM documents""",
    "fold_text": f"SELECT doc_id, md5({collapsed('lower(strip_accents(text))')}) AS folded_md5, len({tok('text')}) AS n_tokens FROM documents",
    "literal_extract": r"""WITH s AS (SELECT o_orderkey, 'Em ' || strftime(o_orderdate, '%d/%m/%Y') || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ') pagou R$ ' || replace(printf('%.2f', o_totalprice), '.', ',') || ' com ' || (o_orderkey % 90) || ',5% de multa' AS s FROM orders)
      SELECT o_orderkey, array_to_string(list_concat(list_concat(list_concat(regexp_extract_all(s, '\d{2}/\d{2}/\d{4}'), regexp_extract_all(s, '\d{4}-\d{2}-\d{2}')), list_concat(regexp_extract_all(s, 'R\$\s?[\d.]+(?:,\d{2})?'), regexp_extract_all(s, '\d+(?:,\d+)?\s?%'))), regexp_extract_all(s, '\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}')), '|') AS literals,
      array_to_string(list_transform(regexp_extract_all(s, '\b\d{2}/\d{2}/\d{4}\b'), lambda x: x[7:10] || '-' || x[4:5] || '-' || x[1:2]), '|') AS dates FROM s""",
    "dense_excerpts": f"""WITH x AS (SELECT doc_id, {collapsed(stripped("('Num. 123 - Pág. 4 ' || text)"))} AS a, {collapsed("('Num. 123 - Pág. 4 ' || text)")} AS b FROM documents), y AS (SELECT doc_id, CASE WHEN length(a) >= 40 THEN a ELSE b END AS e FROM x)
      SELECT doc_id, CASE WHEN length(e) > 240 THEN substr(e, 1, 240) || ' …' ELSE e END AS excerpt FROM y""",
    "classify_court_pages": f"""WITH {QUALITY}, x AS (SELECT d.doc_id, {quoted(COURT_HEADS)}[d.doc_id % 16 + 1] || '. ' || lower(strip_accents(coalesce(text, ''))) AS f, len(r) = 0 AS ok FROM documents d JOIN ql USING (doc_id)),
      y AS (SELECT doc_id, ok, NOT ok AND doc_id % 7 <> 0 AS unread, CASE {" ".join(f"WHEN regexp_matches(f, '{chr(92)}b{p}{chr(92)}b') THEN '{v}'" for v, p in COURT_RULES)} END AS found FROM x),
      z AS (SELECT doc_id, CASE WHEN unread THEN 'unknown' WHEN found IS NOT NULL THEN found WHEN doc_id % 5 = 0 THEN 'sentenca' ELSE 'unknown' END AS piece_type,
        CASE WHEN unread THEN 0.1 WHEN found IS NOT NULL THEN CASE WHEN ok THEN 0.85 ELSE 0.55 END WHEN doc_id % 5 = 0 THEN 0.45 WHEN ok THEN 0.35 ELSE 0.1 END::DOUBLE AS confidence,
        CASE WHEN unread THEN 'unread_unknown' WHEN found IS NOT NULL THEN 'regex:' || found WHEN doc_id % 5 = 0 THEN 'neighbor_continuation' ELSE 'no_signal' END AS signal FROM y)
      SELECT *, list_contains({quoted(COURT_CRITICAL)}, piece_type) OR (confidence < 0.2 AND piece_type = 'unknown') AS critical FROM z""",
    "court_concepts": f"""WITH x AS (SELECT doc_id, {quoted(COURT_TERMS)}[doc_id % 6 + 1] || '. ' || lower(strip_accents(coalesce(text, ''))) AS f FROM documents)
      SELECT doc_id, array_to_string(list_filter({quoted(COURT_CONCEPTS)}, lambda c: contains(f, c)), ',') AS concepts FROM x""",
    "classify_pages": f"""WITH {QUALITY}, x AS (SELECT doc_id, len(r) = 0 AS ok, CASE {' '.join(f"WHEN regexp_matches(f, '{p}') THEN '{v}'" for v, p in GEN)} END AS c FROM ql JOIN (SELECT doc_id, lower(strip_accents(text)) AS f FROM documents) USING (doc_id))
      SELECT doc_id, CASE WHEN ok AND c IS NOT NULL THEN c ELSE 'unknown' END AS piece_type, (CASE WHEN NOT ok THEN 0.1 WHEN c IS NOT NULL THEN 0.85 ELSE 0.35 END)::DOUBLE AS confidence FROM x""",
    "legal_concepts": "SELECT doc_id, array_to_string(list_filter(['the', 'of', 'licensed', 'und'], lambda c: contains(lower(strip_accents(text)), c)), ',') AS concepts FROM documents",
    "case_slugs": r"""WITH x AS (SELECT page_id, list_filter(regexp_split_to_array(url, '[\\/]'), lambda s: s <> '') AS p FROM pages), y AS (SELECT page_id, substr(trim(regexp_replace(lower(strip_accents(regexp_replace(p[-1], '\.[A-Za-z0-9]+$', ''))), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS s FROM x)
      SELECT page_id, CASE WHEN coalesce(s, '') = '' THEN 'caso' ELSE s END AS slug FROM y""",
    "source_system_detect": f"WITH {STAMPED} SELECT case_id, sistema, n_pages, CASE WHEN sistema = 'desconhecido' THEN 0 ELSE m END AS mapped FROM sys",
    "document_map": f"WITH {STAMPED} SELECT case_id, sistema, num, first_page, last_page, pages, signed_date, signer, piece_type, citacao FROM dmap",
    "page_to_document": """WITH doc AS (SELECT o_custkey % 20 AS case_id, o_orderkey::VARCHAR AS num, o_orderkey % 5000 AS first_page, o_orderkey % 5000 + o_custkey % 7 AS last_page FROM orders),
      pg AS (SELECT l_suppkey % 20 AS case_id, l_partkey * 3 + l_linenumber AS page, l_orderkey, l_linenumber FROM lineitem),
      hit AS (SELECT case_id, page, num, first_page, last_page FROM (SELECT DISTINCT case_id, page FROM pg) JOIN doc USING (case_id) WHERE page BETWEEN first_page AND last_page QUALIFY row_number() OVER (PARTITION BY case_id, page ORDER BY first_page, num) = 1)
      SELECT pg.case_id, pg.page, l_orderkey, l_linenumber, num, first_page, last_page FROM pg LEFT JOIN hit ON hit.case_id = pg.case_id AND hit.page = pg.page""",
    "page_citation": f"""WITH {STAMPED}, pg AS (SELECT DISTINCT sp.case_id, sp.page, sp.conv_id, sp.turn, sp.hit FROM sp),
      x AS (SELECT pg.*, dmap.num, dmap.first_page, dmap.citacao AS c, sys.sistema FROM pg LEFT JOIN dmap ON dmap.case_id = pg.case_id AND pg.page BETWEEN dmap.first_page AND dmap.last_page LEFT JOIN sys ON sys.case_id = pg.case_id QUALIFY row_number() OVER (PARTITION BY pg.case_id, pg.page ORDER BY dmap.first_page, dmap.num) = 1)
      SELECT case_id, page, num, CASE WHEN num IS NOT NULL THEN CASE WHEN sistema = 'eproc' THEN turn ELSE page - first_page + 1 END END AS pag_no_documento,
      CASE WHEN num IS NULL AND sistema = 'estj' AND hit THEN (conv_id * 10 + turn)::INT END AS folha_estj,
      CASE WHEN num IS NOT NULL AND sistema = 'eproc' THEN c || ', p. ' || turn WHEN num IS NOT NULL THEN c || ', pág. ' || (page - first_page + 1) WHEN sistema = 'estj' AND hit THEN 'e-STJ, fl. ' || (conv_id * 10 + turn) END AS citacao FROM x""",
    "group_remainder": f"""WITH {STAMPED}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, piece_type ORDER BY first_page, num) AS k FROM dmap WHERE piece_type NOT IN ('inicial', 'contestacao', 'sentenca') AND pages < 4)
      SELECT case_id, piece_type AS tipo, count(*) AS count, sum(pages)::BIGINT AS total_paginas, min(first_page) || '-' || max(last_page) AS intervalo, string_agg(citacao, '|' ORDER BY k) FILTER (WHERE k <= 2) AS exemplos FROM r GROUP BY ALL""",
    "case_page_window": f"""WITH {STAMPED}, w AS (SELECT case_id, num, row_number() OVER (PARTITION BY case_id ORDER BY first_page, num) - 1 AS position, count(*) OVER (PARTITION BY case_id) AS total FROM dmap)
      SELECT *, total > 7 AS has_more FROM w WHERE position BETWEEN 2 AND 6""",
    "panel_counts": f"WITH {STAMPED}, c AS (SELECT case_id, piece_type, count(*) AS n FROM dmap GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, piece_type) AS position FROM c",
    "event_reconcile": f"WITH {RAW} SELECT case_id, event_id, tipo, modalidade, data AS data_documento, descricao, canonical AS canonical_evidence_id, n_evidence, evidence_ids, reading_confidence::DOUBLE AS reading_confidence, CASE WHEN a THEN 'ambiguous' ELSE 'reconciled' END AS status FROM rec",
    "event_ambiguity": f"WITH {RAW} SELECT case_id, tipo, count(*) FILTER (WHERE a) AS ambiguous, count(*) AS n FROM rec GROUP BY ALL",
    "event_extract": """WITH u AS (SELECT (o_custkey % 100)::VARCHAR AS case_id, o_orderkey AS page, o_orderkey % 4 AS k, o_orderkey % 3 = 0 AS j, strftime(o_orderdate, '%Y-%m-%d') AS d1, strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') AS d2 FROM orders),
      e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY page) AS n FROM u WHERE k <> 2)
      SELECT case_id, 'raw-' || lpad(n::VARCHAR, 6, '0') AS raw_event_id, CASE k WHEN 0 THEN 'citacao' WHEN 1 THEN 'sentenca' ELSE 'contestacao' END AS tipo, CASE WHEN k = 0 THEN 'mandado' END AS subtipo,
      CASE k WHEN 0 THEN 'oficial_justica' WHEN 1 THEN 'diario_justica' END AS modalidade, d1 AS data_documento, CASE WHEN j THEN d2 END AS data_juntada, 'case:' || case_id || ':page:' || page || ':unit:p001' AS evidence_id, 0.95::DOUBLE AS reading_confidence FROM e""",
    "timeline_union": f"""WITH {RAW}, a AS (SELECT case_id, data, 'evento' AS origem, tipo, canonical AS ref, 0 AS s, 0 AS p, event_id AS i FROM rec
        UNION ALL SELECT (o_custkey % 50)::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), 'juntada', o_orderpriority, o_orderkey::VARCHAR, 1, o_orderkey, o_orderkey::VARCHAR FROM orders),
      b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY data, s, p, i) AS position FROM a WHERE data >= '1995-01-01' AND data <= '2024-06-30')
      SELECT case_id, data, origem, tipo, count(*) AS n, min(position) AS first_position, max(ref) AS last_ref FROM b GROUP BY ALL""",
    "procedural_radar": f"""WITH {RAW}, e AS (SELECT *, 'radar-' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY data, event_id)::VARCHAR, 4, '0') AS radar_id FROM rec WHERE tipo = 'purchase')
      SELECT case_id, lista, radar_id, event_id AS evento_base, tp AS tipo, CASE WHEN reading_confidence >= 0.85 THEN 'alta' ELSE 'media' END AS reading_confidence, 'media' AS extraction_confidence
      FROM e, (VALUES ('prazo', 'contestacao'), ('oportunidade', 'intempestividade_adversaria')) AS v(lista, tp)""",
    "phase_detect": """WITH l AS (SELECT o_custkey::VARCHAR AS case_id, o_orderkey AS page, ['inicial', 'contestacao', 'replica', 'sentenca', 'recurso'][o_orderpriority[1]::INT] AS t FROM orders),
      h AS (SELECT case_id, count(DISTINCT t) AS n, bool_or(t = 'recurso') AS rc, bool_or(t = 'sentenca') AS se, bool_or(t = 'replica') AS re, bool_or(t = 'contestacao') AS co, bool_or(t = 'inicial') AS ini FROM l GROUP BY case_id),
      r AS (SELECT case_id, n, CASE WHEN rc AND se THEN 'recursal' WHEN se THEN 'decisoria' WHEN re THEN 'instrucao' WHEN co THEN 'defesa' WHEN ini THEN 'postulatoria' ELSE 'nao-identificavel' END AS f,
        CASE WHEN rc AND se THEN 'recurso' WHEN se THEN 'sentenca' WHEN re THEN 'replica' WHEN co THEN 'contestacao' WHEN ini THEN 'inicial' END AS a FROM h)
      SELECT r.case_id, f AS fase_id, a AS ancora, min(page) AS ancora_primeira, max(page) AS ancora_ultima, CASE WHEN f = 'recursal' OR (a IS NOT NULL AND n > 2) THEN 'alta' ELSE 'media' END AS confianca FROM r LEFT JOIN l ON l.case_id = r.case_id AND l.t = r.a GROUP BY ALL""",
    "header_facts_argmax": "SELECT o_custkey AS case_id, o_orderstatus AS papel, round(o_totalprice / 100000, 1) AS confianca, o_orderkey AS page FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY round(o_totalprice / 100000, 1) DESC, o_orderkey) = 1",
    "header_parties": """SELECT c_custkey::VARCHAR AS case_id, papel, CASE papel WHEN 'autor' THEN c_name WHEN 'reu' THEN 'Empresa ' || c_mktsegment ELSE 'R$ 1.234,' || lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS nome,
      'case:' || c_custkey || ':page:1:unit:p001' AS evidence_id, (CASE papel WHEN 'autor' THEN 0.9 WHEN 'reu' THEN 0.8 ELSE 1.0 END)::DOUBLE AS confianca FROM customer, (VALUES ('autor'), ('reu'), ('valor')) AS v(papel)""",
    "never_extracted": f"WITH {LEDGER} SELECT case_id, page FROM miss",
    "critical_gaps_by_type": f"WITH {LEDGER} SELECT * FROM gap",
    "coverage_manifest": f"""WITH {LEDGER}, l AS (SELECT case_id, count(*) FILTER (WHERE state IN ('done', 'ocr_done')) AS pages_read,
        string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE state = 'ocr_needed') AS a, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE state = 'ocr_done') AS b, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE state = 'failed_retryable') AS c,
        string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE state = 'ocr_done' AND y = 'stamp_only') AS d, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE piece_type = 'unknown' AND chars = 0 AND state = 'ocr_needed') AS e FROM led GROUP BY case_id),
      g AS (SELECT case_id, count(*) AS n, max(CASE WHEN kind = 'ingest_incomplete' THEN n_pages END) AS m FROM gap GROUP BY case_id)
      SELECT cases.case_id, coalesce(pages_read, 0) AS pages_read, coalesce(a, '') AS pages_ocr_needed, coalesce(b, '') AS pages_ocr_done, coalesce(c, '') AS pages_failed_retryable, coalesce(d, '') AS pages_ocr_stamp_only, coalesce(e, '') AS pages_unknown_unread,
      coalesce(n, 0) AS n_gaps, coalesce(m, 0) AS never_extracted, coalesce(n, 0) = 0 AS global_analysis_allowed FROM cases LEFT JOIN l USING (case_id) LEFT JOIN g USING (case_id)""",
    "latest_job": f"WITH {JOBS} SELECT case_id, job_id, status, total_pages FROM last",
    "status_summary": f"""WITH {JOBS}, {LEDGER}, l AS (SELECT case_id, count(*) AS r, count(*) FILTER (WHERE state IN ('done', 'ocr_done')) AS p, count(*) FILTER (WHERE state = 'ocr_needed') AS o FROM led GROUP BY case_id),
      x AS (SELECT last.case_id, status, greatest(total_pages, coalesce(r, 0)) AS total_pages, coalesce(p, 0) AS processed, coalesce(o, 0) AS o, epoch_ms(TIMESTAMP '2024-06-01') - epoch_ms(ts) AS age, age <= 120000 AS live FROM last LEFT JOIN l USING (case_id))
      SELECT case_id, status, total_pages, processed, o AS n_needs_ocr, CASE WHEN status IN ('running', 'queued') AND NOT live THEN 'retomar_ingestao (interrompida)' WHEN status = 'running' AND live THEN 'aguardar' WHEN status = 'paused_awaiting_ocr_approval' THEN 'autorizar_ocr'
      WHEN status = 'error' THEN 'retomar_ingestao' WHEN o > 0 THEN 'retomar_ingestao (paginas pendentes)' END AS proxima_acao, CASE WHEN o > 0 THEN {cost('o')} END AS custo_estimado,
      CASE WHEN status IN ('running', 'queued') THEN CASE WHEN live THEN 'preparação em andamento (último sinal há ' || greatest(1, round(age / 1000.0)::BIGINT) || 's)' ELSE 'preparação INTERROMPIDA há ~' || round(age / 60000.0)::BIGINT || ' min' END END AS execucao FROM x""",
    "ocr_estimates": f"WITH {LEDGER}, l AS (SELECT case_id, count(*) FILTER (WHERE state IN ('ocr_needed', 'failed_retryable')) AS pending FROM led GROUP BY case_id) SELECT case_id, pending, pending > 2 AS requires_approval, pending <= 2 AS may_run FROM l",
    "resume_pages": f"""WITH {LEDGER} SELECT l_orderkey AS case_id, l_linenumber AS page FROM lineitem ANTI JOIN (SELECT * FROM led WHERE state IN ('done', 'ocr_done')) x
      ON x.case_id = l_orderkey AND x.page = l_linenumber AND x.h = sha256((l_partkey + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR)""",
    "topic_matrix": f"""WITH {bm25("(SELECT topic || '#' || query_idx AS query_id, query FROM " + values(TOPICS, "topic, query_idx, query") + ")", 24)},
      h AS (SELECT split_part(query_id, '#', 1) AS topic, split_part(query_id, '#', 2)::INT AS qi, rank, doc_id FROM lex), u AS (SELECT topic, doc_id, min(ROW(qi, rank)) AS first_at FROM h GROUP BY ALL),
      r AS (SELECT topic, u.doc_id, first_at, CASE lang WHEN 'en' THEN 'inicial' WHEN 'de' THEN 'contestacao' WHEN 'fr' THEN 'atos_judiciais' ELSE 'fontes_primarias' END AS role FROM u JOIN documents ON documents.doc_id = u.doc_id)
      SELECT topic, role, row_number() OVER (PARTITION BY topic, role ORDER BY first_at, doc_id) AS position, doc_id, CASE role WHEN 'inicial' THEN 'alegacao_autor' WHEN 'contestacao' THEN 'alegacao_reu' WHEN 'atos_judiciais' THEN 'ato_judicial' ELSE 'prova_primaria' END AS source_kind FROM r QUALIFY position <= 4""",
    "claims_verify": f"""WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), b AS (SELECT item_id, text, CASE WHEN item_id % 10 = 0 THEN n + item_id ELSE item_id * 7919 % n END AS e FROM benchmark, n),
      c AS (SELECT item_id, e, coalesce(CASE WHEN item_id % 2 = 1 THEN replace(d.text, ' ', '  ') ELSE b.text END, '') AS s FROM b LEFT JOIN documents d ON d.doc_id = e),
      j AS (SELECT c.*, d.doc_id IS NOT NULL AS known, {collapsed('lower(strip_accents(s))')} AS ex, contains({collapsed("lower(strip_accents(coalesce(text, '')))")}, {collapsed('lower(strip_accents(s))')}) AS ok FROM c LEFT JOIN documents d ON d.doc_id = c.e),
      k AS (SELECT *, CASE WHEN item_id % 3 = 0 AND NOT (known AND ok AND contains(ex, '12%')) THEN '12%' ELSE '' END AS ml, CASE WHEN item_id % 4 = 2 THEN 'd2' ELSE '' END AS md FROM j)
      SELECT item_id::VARCHAR AS claim_id, CASE WHEN NOT known THEN 'evidencia_inexistente' WHEN NOT ok OR ex = '' THEN 'trecho_nao_encontrado' WHEN ml <> '' THEN 'literal_nao_suportado' WHEN md <> '' THEN 'doc_id_nao_registrado' ELSE 'ok' END AS status,
      1::BIGINT AS n_supports, (known AND ok)::BIGINT AS n_ok, ml AS missing_literals, md AS missing_docs FROM k""",
    "reference_missing_ids": "SELECT DISTINCT vec_id AS doc_id FROM embeddings ANTI JOIN labels ON vec_id = doc_id",
    "upsert_replace": """WITH n AS (SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 1000000 ELSE 0 END AS doc_id, 'new' AS source, n_chars * 2 AS n_chars FROM documents WHERE doc_id % 3 = 0)
      SELECT doc_id, source, n_chars FROM documents ANTI JOIN n USING (doc_id) UNION ALL SELECT * FROM n""",
    "vector_delete": "SELECT vec_id, label FROM embeddings ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) x ON x.doc_id = vec_id",
    "job_patch": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "registry_merge": """WITH n AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 5000000 ELSE 0 END AS k, CASE WHEN p_partkey % 3 = 0 THEN 'renamed' END AS nm, 'B#0' AS b FROM part WHERE p_partkey % 5 = 0)
      SELECT coalesce(p_partkey, k) AS p_partkey, coalesce(nm, p_name) AS p_name, coalesce(b, p_brand) AS p_brand FROM part FULL JOIN n ON p_partkey = k""",
    "dossier_append": """WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents), b AS (SELECT (item_id % 3)::VARCHAR AS case_id, CASE WHEN length(trim(text)) > 600 THEN substr(trim(text), 1, 600) || ' …' ELSE trim(text) END AS a, (item_id * 7919 % (n * 2))::VARCHAR AS e FROM benchmark, n),
      x AS (SELECT DISTINCT case_id, 'ach-' || substr(sha256(a || '|' || e || ',1'), 1, 12) AS achado_id, length(a) AS n_chars, e || ',1' AS evidence_ids FROM b WHERE e IN (SELECT doc_id::VARCHAR FROM documents))
      SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY achado_id) <= 500""",
    "deadline_lookup": "SELECT p_partkey, p_type FROM part WHERE contains(lower(strip_accents(p_type)), 'economy') OR contains(lower(strip_accents(p_name)), 'economy')",
    "stream_ingest_counts": "SELECT event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY 1",
}

from evidentia.plans import case_sql, engine_sql  # noqa: E402

SQL |= case_sql.SQL | engine_sql.SQL
