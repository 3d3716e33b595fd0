"""Classification, event extraction and reconciliation, timeline, radar,
phases, header facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.functions.identity import event_id, page_of, sorted_evidence
from evidentia.functions.text import bound, collapse, dates, dense_excerpt, first_match, fold
from evidentia.operators.docmap import PAGE_BLOCK, page_to_document
from evidentia.operators.running import numbered
from evidentia.rules import PT_LEGAL, RulePack, first_rule
from evidentia.sources.shared import written

OCR_READING, NATIVE_READING, EXTRACTION = 0.75, 0.95, 0.8


def classify(text: Column, reliable: Column, label: Column | None = None, previous: Column | None = None, pack: RulePack = PT_LEGAL) -> Column:
    """struct(piece_type, confidence, signal) of a page.

    An unreliable text without a label is unknown (0.1).  The first rule found
    in label and text counts 0.85, 0.55 if the text is unreliable; else the
    previous page's type goes on (0.45); else unknown (0.35, 0.1)."""
    label = label if label is not None else F.lit(None).cast("string")
    previous = previous if previous is not None else F.lit(None).cast("string")
    hay = fold(F.trim(F.concat(F.coalesce(label, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))))
    found = first_rule(hay, pack.pieces)
    make = lambda t, c, s: F.struct(t.alias("piece_type"), F.lit(c).cast("double").alias("confidence") if not isinstance(c, Column) else c.cast("double").alias("confidence"), s.alias("signal"))
    unread = ~reliable & (F.coalesce(label, F.lit("")) == "")
    return (
        F.when(unread, make(F.lit("unknown"), 0.1, F.lit("unread_unknown")))
        .when(found.isNotNull(), make(found, F.when(reliable, 0.85).otherwise(0.55), F.concat(F.lit("regex:"), found)))
        .when(previous.isNotNull() & (previous != "unknown"), make(previous, 0.45, F.lit("neighbor_continuation")))
        .otherwise(make(F.lit("unknown"), F.when(reliable, 0.35).otherwise(0.1), F.lit("no_signal")))
    )


def is_critical(piece: Column, unread: Column, pack: RulePack = PT_LEGAL) -> Column:
    return (unread & (piece == "unknown")) | piece.isin(*pack.critical)


def extract_events(units: DataFrame, pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """At most one raw event per unit (case, page, unit_id, unit_type,
    evidence_id, text): it needs a type and a date.  Numbered per case by page
    and unit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    folded = fold(text)
    kind = first_rule(folded, pack.events)
    ds = dates(text)
    sub = F.lit(None).cast("string")
    for k, v in pack.subtypes.items():
        sub = F.when(F.col("tipo") == k, F.lit(v)).otherwise(sub)
    ocr = F.col("unit_type") == "ocr_paragraph"
    e = units.withColumns({"tipo": kind, "_d": ds, "_f": folded}).filter(F.col("tipo").isNotNull() & (F.size("_d") > 0))
    e = e.select(
        case, "page", "unit_id", "tipo", sub.alias("subtipo"), first_rule(F.col("_f"), pack.modes).alias("modalidade"),
        F.col("_d")[0].alias("data_documento"),
        F.when((F.size("_d") >= 2) & F.regexp_like("_f", F.lit(pack.joined)), F.try_element_at("_d", F.lit(2))).alias("data_juntada"),
        F.lit("texto_do_documento").alias("fonte_data"), F.substring(text, 1, 240).alias("descricao"), F.array("evidence_id").alias("evidence_ids"),
        F.when(ocr, OCR_READING).otherwise(NATIVE_READING).alias("reading_confidence"), F.lit(EXTRACTION).alias("extraction_confidence"),
        F.when(ocr, "ocr").otherwise("native").alias("source"),
    )
    e = written(e).withColumn("_b", page_block(F.col("page")))
    e = numbered(e, [case], ["_b"], ["page", "unit_id"], "_n").drop("_b")
    return e.withColumn("raw_event_id", padded("raw-", F.col("_n"), 6)).drop("_n")


def padded(prefix: str, n: Column, width: int) -> Column:
    """``prefix`` and a number of ``width`` digits at least."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))


def page_block(page: Column) -> Column:
    """Blocks of 1,024 pages, those without a number first."""
    return F.coalesce(F.floor(page / PAGE_BLOCK).cast("long"), F.lit(-(1 << 62)).cast("long"))


def by_day(df: DataFrame, day: Column, rest: Column) -> tuple[DataFrame, list[str]]:
    """``df`` with levels of an order by day and then by what ``rest`` is the
    first part of: months, days, and parts of a day.  ``day`` isn't null."""
    return df.withColumns({"_l0": F.substring(day, 1, 7), "_l1": day, "_l2": rest}), ["_l0", "_l1", "_l2"]


KEY = ("tipo", "subtipo", "modalidade", "data_documento", "data_juntada")


def reconcile(raw: DataFrame, case: str = "case_id", order: str = "raw_event_id") -> DataFrame:
    """Raw events with equal type, subtype, mode and dates as one event: union
    of evidence, least confidences, first description.  It is ambiguous if the
    first one's act has several date pairs on its page."""
    k = [F.coalesce(F.col(c), F.lit("")) for c in KEY]
    first_ev = F.col("evidence_ids")[0]
    r = raw.withColumns({"_page": F.coalesce(page_of(first_ev).cast("string"), F.lit("unknown")), "_pair": F.concat_ws("|", k[3], k[4])})
    base = [case, *(F.coalesce(F.col(c), F.lit("")).alias(f"_b{i}") for i, c in enumerate(KEY[:3])), "_page"]
    pairs = r.groupBy(*base).agg((F.min("_pair") != F.max("_pair")).alias("_amb"))
    g = r.groupBy(case, *(F.coalesce(F.col(c), F.lit("")).alias(f"_k{i}") for i, c in enumerate(KEY))).agg(
        F.min_by(F.struct(*KEY, "fonte_data", "descricao", "_page"), order).alias("f"),
        F.array_distinct(F.flatten(F.collect_set("evidence_ids"))).alias("_ids"),
        F.min("reading_confidence").alias("reading_confidence"),
        F.min("extraction_confidence").alias("extraction_confidence"),
    )
    g = g.select(case, "f.*", sorted_evidence(F.col("_ids")).alias("evidence_ids"), "reading_confidence", "extraction_confidence")
    g = g.withColumns({f"_b{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(KEY[:3])})
    g = g.join(pairs, [case, "_b0", "_b1", "_b2", "_page"], "left")
    first = F.col("evidence_ids")[0]
    day = F.coalesce("data_documento", "data_juntada")
    amb = F.coalesce("_amb", F.lit(False))
    return g.select(
        case, event_id(F.col(case), F.col("tipo"), F.col("subtipo"), F.col("modalidade"), day, first, F.col("descricao")).alias("event_id"),
        *KEY, "fonte_data", "descricao", first.alias("canonical_evidence_id"), "evidence_ids", "reading_confidence", "extraction_confidence",
        F.when(amb, F.array(F.lit("conflito de data para ato semelhante na mesma pagina"))).otherwise(F.array().cast("array<string>")).alias("ambiguities"),
        F.when(amb, "ambiguous").otherwise("reconciled").alias("status"),
    )


def timeline(events: DataFrame, documents: DataFrame, since: str | None = None, until: str | None = None, case: str = "case_id") -> DataFrame:
    """Events and filings in one list with ``position`` per case: by date,
    undated last; undated rows only without a bound."""
    e = events.filter(F.col("status") != "superseded").select(
        case, F.coalesce("data_documento", "data_juntada").alias("data"), F.lit("evento").alias("origem"),
        F.when(F.col("subtipo").isNotNull(), F.concat_ws("/", "tipo", "subtipo")).otherwise(F.col("tipo")).alias("tipo"),
        F.coalesce(dense_excerpt("descricao", 140), F.lit("")).alias("resumo"), F.col("canonical_evidence_id").alias("ref"),
        F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("p"), F.col("event_id").alias("i")).alias("_o"),
    )
    what = F.when(F.col("evento").isNotNull(), F.col("citacao")).otherwise(F.concat(F.lit("Num. "), F.col("num")))
    signer = F.when(F.col("signer").isNotNull(), F.concat(F.lit(", assinado por "), F.col("signer"))).otherwise("")
    d = documents.select(
        case, F.col("signed_date").alias("data"), F.lit("juntada").alias("origem"), F.col("piece_type").alias("tipo"),
        F.concat(F.lit("Documento "), what, F.format_string(" juntado (%d pág., %d-%d", F.col("pages").cast("long"), F.col("first_page").cast("long"), F.col("last_page").cast("long")), signer, F.lit(")")).alias("resumo"),
        F.col("num").alias("ref"), F.struct(F.lit(1).alias("s"), F.col("first_page").cast("long").alias("p"), F.col("num").alias("i")).alias("_o"),
    )
    t = e.unionByName(d)
    if since or until:
        t = t.filter(F.col("data").isNotNull())
    if since:
        t = t.filter(F.col("data") >= since)
    if until:
        t = t.filter(F.col("data") <= until)
    t = written(t)
    # of one day events stand first, by id; filings by page
    part = F.when(F.col("_o.s") == 0, F.concat(F.lit("0"), F.substring(F.coalesce("_o.i", F.lit("")), 1, 7))).otherwise(F.concat(F.lit("1"), F.lpad(F.greatest(page_block(F.col("_o.p")), F.lit(0)).cast("string"), 12, "0")))
    t, levels = by_day(t, F.coalesce("data", F.lit("~")), part)
    return numbered(t, [case], levels, [F.col("data").asc_nulls_last(), "_o"], "position").drop("_o", *levels)


def confidence_bucket(v: Column) -> Column:
    return F.when(v >= 0.85, "alta").when(v >= 0.6, "media").otherwise("baixa")


#: Checks that go with a deadline candidate.
CAVEATS = (
    "confirmar termo inicial",
    "confirmar modalidade de citacao",
    "confirmar data de juntada ou perfectibilizacao",
    "confirmar feriados locais",
    "contagem em dias uteis depende de calendario aplicavel",
)


def radar(events: DataFrame, side: str, deadlines: DataFrame | None = None, trigger: str = "citacao", deadline_id: str = "contestacao-procedimento-comum", case: str = "case_id") -> DataFrame:
    """Two items per triggering event, a deadline candidate and an
    opportunity, each numbered per case; the deadline's reference row if
    ``deadlines`` is given.  Always to be checked, never a conclusion."""
    e = written(events.filter(F.col("tipo") == trigger))
    day = F.coalesce("data_documento", "data_juntada")
    e, levels = by_day(e, F.coalesce(day, F.lit("")), F.substring(F.coalesce("event_id", F.lit("")), 1, 7))
    e = numbered(e, [case], levels, [day, "event_id"], "_n").drop(*levels)
    e = e.withColumn("radar_id", padded("radar-", F.col("_n"), 4)).drop("_n")
    common = (case, "radar_id", F.col("event_id").alias("evento_base"), "evidence_ids", confidence_bucket(F.col("reading_confidence")).alias("reading_confidence"), confidence_bucket(F.col("extraction_confidence")).alias("extraction_confidence"))
    none = F.array().cast("array<string>")
    a = e.select(F.lit("prazo").alias("lista"), *common, F.lit("contestacao").alias("tipo"), F.lit("conferir").alias("status"), F.lit(side).alias("lado_favorecido"), F.lit("Contestacao pode exigir conferencia de tempestividade.").alias("hipotese"), F.array(*map(F.lit, CAVEATS)).alias("ressalvas"), F.lit(None).cast("string").alias("acao_sugerida"), F.lit(deadline_id).alias("_id"))
    b = e.select(F.lit("oportunidade").alias("lista"), *common, F.lit("intempestividade_adversaria").alias("tipo"), F.lit("conferir").alias("status"), F.lit(side).alias("lado_favorecido"), F.lit("Ha indicio para conferir tempestividade de manifestacao adversaria.").alias("hipotese"), none.alias("ressalvas"), F.lit("Conferir calendario forense e avaliar preliminar.").alias("acao_sugerida"), F.lit(None).cast("string").alias("_id"))
    out = a.unionByName(b)
    if deadlines is None:
        return out.withColumn("prazo_referencia", F.lit(None).cast("string")).drop("_id")
    ref = deadlines.select(F.col("id").alias("_id"), F.to_json(F.struct("ato", "prazo", "unidade", "base_legal", "observacoes")).alias("prazo_referencia"))
    return out.join(ref, "_id", "left").drop("_id")


def radar_union(items: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, itens): both lists of a case's radar as one, deadlines first."""
    first = F.when(F.col("lista") == "prazo", 0).otherwise(1)
    cols = [c for c in ("lista", "radar_id", "tipo", "status", "hipotese") if c in items.columns]
    return items.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col("radar_id").alias("r"), F.struct(*cols).alias("item")))).alias("i")).select(case, F.transform("i", lambda x: x["item"]).alias("itens"))


def head_units(units: DataFrame, n: int = 10, case: str = "case_id") -> DataFrame:
    """The first ``n`` native pages with text of each case."""
    u = units.filter((F.col("unit_type") == "page_text") & (F.length(F.coalesce("text", F.lit(""))) > 0))
    order = [c for c in ("page", "unit_id") if c in u.columns]
    return u.withColumn("_r", F.row_number().over(W.partitionBy(case).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def phase(ledger: DataFrame, documents: DataFrame | None = None, area: str | Column = "civil", pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """The phase that a case's pieces show, from the most advanced rule, with
    its anchor pages and the document that holds the last of them.

    ledger: (case, page, piece_type); area: a name or a column of the ledger.
    Confidence is high if the rule needs other pieces or more than two types
    (unknown counts) are there."""
    area = F.lit(area) if isinstance(area, str) else area
    per = ledger.groupBy(case, "piece_type").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.first(area).alias("area"))
    have = per.groupBy(case).agg(
        F.map_from_entries(F.collect_list(F.struct("piece_type", F.struct("lo", "hi")))).alias("m"), F.count(F.lit(1)).alias("n_types"), F.first("area").alias("area")
    )  # a map of at most the number of piece types
    chosen = None
    for name, rules in pack.phases.items():
        for pid, label, anchor, needs in rules:
            test = (F.col("area") == name) & F.map_contains_key("m", anchor)
            for x in needs:
                test = test & F.map_contains_key("m", x)
            s = F.struct(F.lit(pid).alias("fase_id"), F.lit(label).alias("fase"), F.lit(anchor).alias("ancora"), F.lit(bool(needs)).alias("needs"))
            chosen = F.when(test, s) if chosen is None else chosen.when(test, s)
    r = have.withColumn("r", chosen).withColumn("a", F.col("m")[F.col("r.ancora")])
    out = r.select(
        case, "area", F.coalesce("r.fase_id", F.lit("nao-identificavel")).alias("fase_id"), F.coalesce("r.fase", F.lit("Não identificável pelo caderno")).alias("fase"),
        F.col("r.ancora").alias("ancora"), F.col("a.lo").alias("ancora_primeira"), F.col("a.hi").alias("ancora_ultima"),
        F.when(F.col("r").isNotNull() & (F.col("r.needs") | (F.col("n_types") > 2)), "alta").otherwise("media").alias("confianca"),
    )
    if documents is None:
        return out
    asked = page_to_document(out.filter(F.col("ancora_ultima").isNotNull()).select(case, F.col("ancora_ultima").alias("page")), documents, case, ("citacao",))
    return out.join(asked.select(case, F.col("citacao").alias("ancora_citacao")), case, "left")


# ---------------------------------------------------------------- header facts

#: Labels and phrases of the first pages.
HEADER_RULES = (
    ("autor", 0.9, r"(?iu)\b(?:AUTOR(?:A)?|REQUERENTE|EXEQUENTE|RECLAMANTE|IMPETRANTE|QUERELANTE)\s*[:\-–]\s*([^\n,;]{3,80})"),
    ("autor", 0.7, None),
    ("reu", 0.9, r"(?iu)\b(?:R[ÉE]U?S?|R[ÉE]|REQUERID[OA]S?|EXECUTAD[OA]S?|RECLAMAD[OA]S?|IMPETRAD[OA]S?|DENUNCIAD[OA]S?|ACUSAD[OA]S?|QUERELAD[OA]S?|INDICIAD[OA]S?|INVESTIGAD[OA]S?)\s*[:\-–]\s*([^\n,;]{3,80})"),
    ("reu", 0.8, r"(?u)\bem\s+face\s+d[eao]s?\s+([A-ZÀ-Ú][^,;.\n]{2,79})"),
    ("autor", 0.6, r"(?u)\b((?:[A-ZÀ-Ú][A-ZÀ-Ú']+)(?:\s+(?:DA|DE|DO|DAS|DOS|E|[A-ZÀ-Ú][A-ZÀ-Ú']+))*)\s*,\s*(?:brasileir[oa]|pessoa\s+jur[ií]dica|inscrit[oa]\s+no)"),
)
PROSECUTOR_RE, CHARGE_RE, PROSECUTOR = r"(?iu)MINIST[ÉE]RIO\s+P[ÚU]BLICO", r"(?iu)\bDEN[ÚU]NCIA\b", "MINISTÉRIO PÚBLICO"
VALUE_RE = r"(?iu)valor\s+da\s+causa[^\dR$]{0,30}R?\$?\s*([\d][\d. ]*,\d{2})"
NEXT_LABEL_RE = r"(?u)\s+(?:(?:AUTOR(?:A)?S?|REQUERENTES?|EXEQUENTES?|RECLAMANTES?|IMPETRANTES?|QUERELANTES?|R[ÉE]US?|REQUERID[OA]S?|EXECUTAD[OA]S?|RECLAMAD[OA]S?|IMPETRAD[OA]S?|DENUNCIAD[OA]S?|ACUSAD[OA]S?|QUERELAD[OA]S?|INDICIAD[OA]S?|INVESTIGAD[OA]S?|V[ÍI]TIMAS?|INTERESSAD[OA]S?|ADVOGAD[OA]S?|DESPACHO|DECIS[ÃA]O|SENTEN[ÇC]A|CERTID[ÃA]O|INTIMA[ÇC][ÃA]O|CONCLUS[ÃA]O)\b(?=\s*[:\-–]|\s|$)|R[ÉE]\b(?=\s*[:\-–])).*$"


def clean_name(c: Column) -> Column:
    """A name up to the next label in capitals, without closing marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), NEXT_LABEL_RE, ""), r"[\s.,;:–-]+$", ""))


def header_facts(units: DataFrame, case: str = "case_id", first_units: int = 10) -> DataFrame:
    """(case, papel, nome, evidence_id, confianca): of each role the candidate
    of the highest confidence in the first ten native pages with text, the
    earliest page and rule on ties; role ``valor`` is the first claim value."""
    text = F.col("text")
    heads = head_units(units, first_units, case)
    cands = []
    for i, (role, conf, pattern) in enumerate(HEADER_RULES):
        if pattern is None:
            name = F.when(F.regexp_like(text, F.lit(PROSECUTOR_RE)) & F.regexp_like(text, F.lit(CHARGE_RE)), F.lit(PROSECUTOR))
        else:
            name = clean_name(first_match(text, pattern))
        cands.append(F.struct(F.lit(role).alias("papel"), name.alias("nome"), F.lit(conf).alias("confianca"), F.lit(i).alias("rule")))
    value = first_match(text, VALUE_RE)
    cands.append(F.struct(F.lit("valor").alias("papel"), F.when(value.isNotNull(), F.concat(F.lit("R$ "), value)).alias("nome"), F.lit(1.0).alias("confianca"), F.lit(9).alias("rule")))
    c = heads.select(case, "page", "unit_id", "evidence_id", F.explode(F.array(*cands)).alias("c")).select(case, "page", "unit_id", "evidence_id", "c.*").filter(F.col("nome").isNotNull())
    best = c.groupBy(case, "papel").agg(F.min_by(F.struct("nome", "evidence_id", "confianca"), F.struct(-F.col("confianca"), "page", "unit_id", "rule")).alias("b"))
    return best.select(case, "papel", "b.*")


def argmax_candidates(candidates: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """Of each key the row of the highest score, the first by ``order`` on ties."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), *order))
    return candidates.withColumn("_r", r).filter("_r = 1").drop("_r")


def concepts(text: Column, pack: RulePack = PT_LEGAL) -> Column:
    """The pack's terms that the folded text holds, in the pack's order."""
    return bound(fold(text), lambda f: F.filter(F.array(*map(F.lit, pack.concepts)), lambda t: F.contains(f, t)))


def summary(facts: DataFrame, ledger: DataFrame, events: DataFrame, cases: DataFrame, pack: RulePack = PT_LEGAL, case: str = "case_id") -> DataFrame:
    """(case, resumo): a sentence each for size, parties, the first five piece
    types, the first four dated events, and the value."""
    names = F.create_map(*[F.lit(x) for kv in pack.piece_names.items() for x in kv])
    enames = F.create_map(*[F.lit(x) for kv in pack.event_names.items() for x in kv])
    p = ledger.groupBy(case, "piece_type").agg(F.min("page").alias("at"), F.count(F.lit(1)).alias("n")).withColumn("label", names[F.col("piece_type")]).filter(F.col("label").isNotNull())
    p = p.withColumn("_r", F.row_number().over(W.partitionBy(case).orderBy("at", "piece_type"))).filter("_r <= 5")
    told = F.when(F.col("n") > 1, F.concat(F.col("label"), F.lit(" ("), F.col("n").cast("string"), F.lit(" págs.)"))).otherwise(F.col("label"))
    p = p.groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", told.alias("t")))), lambda s: s["t"]), ", ").alias("pieces"))
    day = F.coalesce("data_documento", "data_juntada")
    e = events.withColumn("label", enames[F.col("tipo")]).filter(F.col("label").isNotNull() & day.isNotNull())
    e = e.withColumn("_r", F.row_number().over(W.partitionBy(case).orderBy(page_of(F.col("canonical_evidence_id")), "event_id"))).filter("_r <= 4")
    e = e.groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat(F.col("label"), F.lit(" em "), day).alias("t")))), lambda s: s["t"]), "; ").alias("dated"))
    f = facts.groupBy(case).agg(*(F.max(F.when(F.col("papel") == r, F.col("nome"))).alias(r) for r in ("autor", "reu", "valor")))
    x = cases.join(f, case, "left").join(p, case, "left").join(e, case, "left")
    parties = F.concat_ws("; ", F.when(F.col("autor").isNotNull(), F.concat(F.lit("autor: "), F.col("autor"))), F.when(F.col("reu").isNotNull(), F.concat(F.lit("réu: "), F.col("reu"))))
    say = lambda c, a, b: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(a), c, F.lit(b)))
    kind = F.when(F.col("area") == "penal", "penal").otherwise("cível")
    return x.select(
        case,
        F.concat_ws(
            " ", F.concat(F.lit("Processo "), kind, F.lit(" com "), F.col("total_pages").cast("string"), F.lit(" página(s).")), say(parties, "Partes identificadas — ", "."),
            say(F.col("pieces"), "Peças identificadas: ", "."), say(F.col("dated"), "Eventos datados: ", "."), say(F.col("valor"), "Valor da causa: ", "."),
        ).alias("resumo"),
    )


