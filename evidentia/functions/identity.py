"""Identifiers, hashes and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col, fold


def sha256(c: ColumnOrName) -> Column:
    return F.sha2(col(c), 256)


def evidence_id(case_id: ColumnOrName, page: ColumnOrName, unit: ColumnOrName) -> Column:
    return F.concat(F.lit("case:"), col(case_id), F.lit(":page:"), col(page).cast("string"), F.lit(":unit:"), col(unit))


def page_of(evidence: ColumnOrName) -> Column:
    return F.when(F.regexp_like(col(evidence), F.lit(r":page:(\d+):")), F.regexp_extract(col(evidence), r":page:(\d+):", 1).cast("long"))


def unit_of(evidence: ColumnOrName) -> Column:
    return F.regexp_extract(col(evidence), r":unit:([^:]+)$", 1)


def sorted_evidence(ids: Column) -> Column:
    """Distinct ids by page (unknown last) and unit."""
    key = lambda i: F.struct(F.coalesce(page_of(i), F.lit(2**53 - 1)).alias("p"), unit_of(i).alias("u"), i.alias("i"))
    return F.transform(F.array_sort(F.transform(F.array_distinct(ids), key)), lambda s: s["i"])


def signature_part(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(fold(F.coalesce(c, F.lit("unknown"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise("unknown")


def event_id(case_id: Column, kind: Column, subtype: Column, mode: Column, date: Column, first_id: Column, description: Column) -> Column:
    """evt- and 12 hex digits of the event's stable signature."""
    text_hash = sha256(F.concat_ws("|", first_id, F.coalesce(description, F.lit(""))))
    sig = F.concat_ws(
        "|", case_id, signature_part(kind), signature_part(subtype), signature_part(mode), F.coalesce(date, F.lit("unknown")),
        F.coalesce(page_of(first_id).cast("string"), F.lit("unknown")), F.substring(text_hash, 1, 12),
    )
    return F.concat(F.lit("evt-"), F.substring(sha256(sig), 1, 12))


def finding_id(text: Column, ids: Column) -> Column:
    return F.concat(F.lit("ach-"), F.substring(sha256(F.concat(text, F.lit("|"), F.array_join(ids, ","))), 1, 12))


def job_id(case_id: Column, at: Column) -> Column:
    return F.concat(F.lit("job-"), case_id, F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"))


def display_ref(ref: Column, event: Column, folio: Column, page: Column) -> Column:
    """A unit's reference: its own, else event and folio, else the page."""
    own = F.when(F.length(F.trim(ref)) > 0, F.trim(ref))
    return F.coalesce(own, F.when(event.isNotNull() & folio.isNotNull(), F.concat_ws(", ", event, folio)), folio, event, F.format_string("pagina %s do PDF", page.cast("string")))


def cite_document(event: Column, label: Column, num: Column) -> Column:
    return F.when(event.isNotNull(), F.concat(F.lit("Evento "), event, F.lit(", "), F.coalesce(label, num))).otherwise(F.concat(F.lit("ID "), num))


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
