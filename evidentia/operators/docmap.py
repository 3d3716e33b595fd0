"""Document map: page stamps to documents, page to document, citations.

Pages: (case_id, page, text) of native page units; ledger: (case_id, page,
piece_type, ...).  All cases at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.functions.identity import cite_document, page_range
from evidentia.functions.text import first_match
from evidentia.operators.running import running

#: What the source systems stamp on a page.
PJE_RE = r"(?u)Num\.\s*(\d+)\s*-\s*P[áa]g\.\s*(\d+)"
SIGNED_RE = r"(?u)Assinado eletronicamente por:\s*(.+?)\s*-\s*(\d{2})/(\d{2})/(\d{4})"
ESTJ_RE = r"(?iu)e-STJ\s+Fl\.?\s*(\d{1,6})"
EPROC_RE = r"(?u)\bEvento\s+(\d{1,4})\s*[-–,]?\s*([A-Z][A-Z0-9]{1,14}\d{1,3})\b(?:\s*[/|-]?\s*P[áa]gina\s+(\d{1,5})\b)?"
PAGE_BLOCK = 1024
MIN_PAGES, EPROC_SHARE, ESTJ_SHARE = 3, 0.3, 0.2
#: Pieces that are listed whatever their length.
PROCEDURAL = ("inicial", "contestacao", "replica", "decisao", "sentenca", "recurso", "denuncia", "resposta_acusacao", "alegacoes_finais")


def parse_stamps(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with the stamps of each page as columns, null without one."""
    signed = lambda g: first_match(text, SIGNED_RE, g)
    internal = first_match(text, EPROC_RE, 3)
    return pages.withColumns(
        {
            "pje_num": first_match(text, PJE_RE, 1),
            "pje_page": first_match(text, PJE_RE, 2).cast("int"),
            "signer": F.substring(F.trim(signed(1)), 1, 80),
            "signed_date": F.concat_ws("-", signed(4), signed(3), signed(2)),
            "evento": first_match(text, EPROC_RE, 1),
            "rotulo": first_match(text, EPROC_RE, 2),
            "eproc_page": F.when(internal != "", internal).cast("int"),
            "folha": first_match(text, ESTJ_RE, 1).cast("int"),
        }
    ).withColumn("signed_date", F.when(F.col("pje_num").isNotNull() & (F.col("signed_date") != ""), F.col("signed_date"))).withColumn("signer", F.when(F.col("pje_num").isNotNull(), F.col("signer")))


def source_system(stamped: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, sistema, n_pages, mapped): PJe with one stamp, eproc with three
    pages and 30 % of them, e-STJ with three and 20 %, else unknown."""
    c = stamped.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("pje_num").alias("pje"),
        F.count("evento").alias("eproc"),
        F.count("folha").alias("estj"),
    )
    n = F.col("n_pages")
    system = (
        F.when(F.col("pje") > 0, "pje")
        .when((F.col("eproc") >= MIN_PAGES) & (F.col("eproc") >= n * EPROC_SHARE), "eproc")
        .when((F.col("estj") >= MIN_PAGES) & (F.col("estj") >= n * ESTJ_SHARE), "estj")
        .otherwise("desconhecido")
    )
    mapped = F.when(F.col("sistema") == "pje", F.col("pje")).when(F.col("sistema") == "eproc", F.col("eproc")).when(F.col("sistema") == "estj", F.col("estj")).otherwise(F.lit(0))
    return c.withColumn("sistema", system).withColumn("mapped", mapped).select(case, "sistema", "n_pages", "mapped")


def document_map(stamped: DataFrame, ledger: DataFrame, case: str = "case_id") -> DataFrame:
    """One row per document of the winning system: num, evento, rotulo,
    first_page, last_page, pages, signed_date, signer, piece_type (of its first
    page), citacao."""
    system = source_system(stamped, case).select(case, "sistema")
    types = ledger.select(case, "page", "piece_type")
    p = stamped.join(system, case).join(types, [case, "page"], "left")
    num = F.when(F.col("sistema") == "pje", F.col("pje_num")).when((F.col("sistema") == "eproc") & F.col("evento").isNotNull(), F.concat_ws(":", "evento", "rotulo"))
    p = p.withColumn("num", num).filter(F.col("num").isNotNull())
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("page")))
    pje = F.col("sistema") == "pje"
    d = p.groupBy(case, "sistema", "num").agg(
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
        F.count(F.lit(1)).alias("pages"),
        first("signed_date").alias("signed_date"),
        first("signer").alias("signer"),
        F.coalesce(F.min_by("piece_type", "page"), F.lit("unknown")).alias("piece_type"),
        F.first("evento").alias("evento"),
        F.first("rotulo").alias("rotulo"),
    )
    d = d.withColumn("evento", F.when(~pje, F.col("evento"))).withColumn("rotulo", F.when(~pje, F.col("rotulo")))
    return d.withColumn("citacao", cite_document(F.col("evento"), F.col("rotulo"), F.col("num")))


def page_to_document(pages: DataFrame, documents: DataFrame, case: str = "case_id", carry: Sequence[str] = ("num", "first_page", "last_page", "piece_type")) -> DataFrame:
    """``pages`` (case, page, ...) with the columns of the document whose
    interval holds the page; of several, the one that starts first (then the
    smallest num); null without one.

    Instead of a range join that compares every page with every document, an
    as-of pass: documents and pages of a case are sorted together, and the
    documents that start at or before a page and reach it are those since the
    running maximum of last pages.  Overlaps are resolved by giving each page
    range to its earliest document first: the ranges are split at their ends,
    and every piece keeps its earliest cover, so that pieces are disjoint and a
    page finds its piece by one lookup of the last start at or before it.
    Pieces are cut at every ``PAGE_BLOCK`` pages, so that a window holds one
    block of a case and a case of any size is spread; the running maximum of
    last pages goes over blocks of documents in the same way.  An interval
    without a number at either end covers nothing.
    """
    b = documents.select(case, *dict.fromkeys(("num", "first_page", "last_page", *carry)))
    cover = F.struct(F.col("first_page").alias("_f"), F.col("num").alias("_n"), F.struct(*[F.col(c) for c in carry]).alias("doc"))
    # disjoint pieces: a document's interval less what earlier ones cover, which is a prefix of it
    b = b.filter(F.col("first_page").isNotNull() & F.col("last_page").isNotNull()).withColumn("_b", F.floor(F.col("first_page") / PAGE_BLOCK))
    pieces = running(b, [case], ["_b"], ["first_page", "num"], {"_before": (F.col("last_page"), "max")}, inclusive=False).drop("_b")
    pieces = pieces.withColumn("_from", F.greatest(F.col("first_page"), F.col("_before") + 1))
    pieces = pieces.filter(F.col("_from") <= F.col("last_page")).select(case, F.col("_from").alias("_at"), F.lit(0).alias("_k"), F.struct(F.col("last_page").alias("_to"), cover.alias("c")).alias("_p"))
    keep = pages.columns
    block = lambda c: F.floor(c / F.lit(PAGE_BLOCK)).cast("long")
    pieces = pieces.withColumn("_blk", F.explode(F.sequence(block(F.col("_at")), block(F.col("_p._to")))))
    pieces = pieces.withColumn("_at", F.greatest(F.col("_at").cast("long"), F.col("_blk") * PAGE_BLOCK))
    marks = pieces.select(case, "_blk", "_at", "_k", "_p", F.lit(None).cast(pages.select(F.struct(*keep)).schema[0].dataType).alias("_row"))
    asks = pages.select(case, block(F.col("page")).alias("_blk"), F.col("page").cast("long").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast(pieces.schema["_p"].dataType).alias("_p"), F.struct(*keep).alias("_row"))
    both = marks.unionByName(asks)
    upto = W.partitionBy(case, "_blk").orderBy("_at", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = both.withColumn("_last", F.last("_p", ignorenulls=True).over(upto)).filter("_k = 1")
    got = hit.withColumn("_doc", F.when(F.col("_last._to") >= F.col("_at"), F.col("_last.c.doc")))
    return got.select("_row.*", *(F.col(f"_doc.{c}").alias(c if c not in keep else f"doc_{c}") for c in carry))


def page_citations(pages: DataFrame, documents: DataFrame, stamped: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, page, num, pag_no_documento, folha_estj, citacao): the document's
    page, by the stamp where there is one, else counted from its first page;
    without a document the e-STJ sheet; else null."""
    asked = page_to_document(pages.select(case, "page"), documents, case, ("num", "first_page", "last_page", "piece_type", "evento", "citacao"))
    system = source_system(stamped, case).select(case, "sistema")
    marks = stamped.select(case, "page", "eproc_page", "folha").dropDuplicates([case, "page"])
    x = asked.join(marks, [case, "page"], "left").join(system, case, "left")
    inner = F.when(F.col("evento").isNotNull() & F.col("eproc_page").isNotNull(), F.col("eproc_page")).otherwise(F.col("page") - F.col("first_page") + 1)
    by_doc = F.when(F.col("evento").isNotNull(), F.concat(F.col("citacao"), F.lit(", p. "), inner.cast("string"))).otherwise(F.concat(F.col("citacao"), F.lit(", pág. "), inner.cast("string")))
    sheet = F.when(F.col("num").isNull() & (F.col("sistema") == "estj"), F.col("folha"))
    return x.select(
        case, "page", "num", F.when(F.col("num").isNotNull(), inner).cast("long").alias("pag_no_documento"), sheet.alias("folha_estj"),
        F.when(F.col("num").isNotNull(), by_doc).otherwise(F.concat(F.lit("e-STJ, fl. "), sheet.cast("string"))).alias("citacao"),
    )


def is_principal(piece: Column, pages: Column, min_pages: int = 3) -> Column:
    return piece.isin(*PROCEDURAL) | (pages >= max(1, min_pages))


def remainder_groups(documents: DataFrame, min_pages: int = 3, case: str = "case_id") -> DataFrame:
    """The documents that aren't principal, by type: count, pages, interval
    and the first two as examples."""
    rest = documents.filter(~is_principal(F.col("piece_type"), F.col("pages"), min_pages))
    example = F.struct(F.col("first_page"), F.col("num"), page_range(F.col("first_page"), F.col("last_page")).alias("paginas"), F.col("citacao"))
    # two smallest without gathering a group: rank, then aggregate
    ranked = rest.withColumn("_r", F.row_number().over(W.partitionBy(case, "piece_type").orderBy("first_page", "num"))).withColumn("_e", F.when(F.col("_r") <= 2, example))
    return ranked.groupBy(case, F.col("piece_type").alias("tipo")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("pages").alias("total_paginas"),
        F.concat_ws("-", F.min("first_page").cast("string"), F.max("last_page").cast("string")).alias("intervalo"),
        F.array_sort(F.collect_list("_e")).alias("exemplos"),
    )


def page_of_documents(documents: DataFrame, limit: int = 50, offset: int = 0, case: str = "case_id") -> DataFrame:
    """A page of each case's documents by first page, with ``total`` and
    ``has_more``; limit 1 to 200."""
    limit, offset = min(max(1, limit), 200), max(0, offset)
    w = W.partitionBy(case)
    n = documents.withColumns({"position": F.row_number().over(w.orderBy("first_page", "num")) - 1, "total": F.count(F.lit(1)).over(w)})
    return n.filter((F.col("position") >= offset) & (F.col("position") < offset + limit)).withColumn("has_more", F.col("total") > offset + limit)
