"""Text functions as Column builders: folding, tokens, quality, stamps,
personal data, secrets, literals, dates, money.  Built-in functions, but for
the character counts of a page's quality, which are one Arrow pass.

JavaScript's white space, used by the rules this follows, is Java's `\\s` with
Unicode classes; digits stay ASCII.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text_counts import character_counts

ColumnOrName = Column | str
SPACE = r"(?U)\s"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once a row: as a plain column it is
    made again in each branch and each turn of a lambda that names it."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- folding and tokens


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks of
    U+0300-036F, and what they fold to; built from the Unicode data."""
    src, dst = [], []
    for cp in range(0xC0, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and all("̀" <= x <= "ͯ" for x in d[1:]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


def fold(c: ColumnOrName) -> Column:
    """Lower case without diacritics.  Texts of ASCII alone skip the table."""
    c = col(c)
    src, dst = fold_table()
    # marks that stand alone come last, without a counterpart: they are deleted
    full = F.lower(F.translate(c, src + "".join(map(chr, range(0x300, 0x370))), dst))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(full)


def collapse(c: ColumnOrName) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def normalize_for_match(c: ColumnOrName) -> Column:
    return collapse(fold(c))


def tokens(c: ColumnOrName) -> Column:
    """Folded maximal runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def slug(c: ColumnOrName, length: int = 80, empty: str = "caso") -> Column:
    """Folded, other characters as single dashes, at most ``length``."""
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, length)
    return F.when(F.length(s) > 0, s).otherwise(F.lit(empty))


def case_slug(path: ColumnOrName) -> Column:
    """Case id of a path: last segment, one extension dropped, as a slug."""
    last = F.try_element_at(F.filter(F.split(col(path), r"[\\/]"), lambda x: x != ""), F.lit(-1))
    return slug(F.coalesce(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), F.lit("")))


# ---------------------------------------------------------------- stamps and quality

#: Stamps that the source systems print on every page.
STAMPS = (
    r"(?iu)Num\.\s*\d+\s*-\s*P[áa]g\.\s*\d+",
    r"(?:Documento\s+)?[Aa]ssinado eletronicamente por:?\s*.{0,80}?\d{2}/\d{2}/\d{4}(?:,?\s*(?:[àa]s\s*)?\d{2}:\d{2}(?::\d{2})?)?(?:\s*-\s*[0-9a-f]{4,12})?",
    r"(?iu)Este documento foi gerado pelo usu[áa]rio\s*[\d.*-]{0,24}(?:\s*em\s*\d{2}/\d{2}/\d{4}(?:\s*\d{2}:\d{2}(?::\d{2})?)?)?",
    r"(?iu)N[úu]mero do (?:documento|processo):?\s*[\d.\-]+",
    r"https?://\S+",
    r"(?iu)Fls\.?\s*:?\s*\d+",
)
MIN_BEYOND_STAMPS = 120
MIN_USEFUL = 20
#: Fixed value: letters and digits.
USEFUL_RE = r"[\p{L}\p{N}]"


def strip_stamps(c: ColumnOrName, stamps: tuple[str, ...] = STAMPS) -> Column:
    c = col(c)
    for p in stamps:
        c = F.regexp_replace(c, p, " ")
    return c


def n_useful(c: ColumnOrName) -> Column:
    return F.regexp_count(col(c), F.lit(USEFUL_RE))


def page_yield(c: ColumnOrName, stamps: tuple[str, ...] = STAMPS) -> Column:
    """struct(yield, useful): ``stamp_only`` if stamps were removed and fewer
    than 120 letters and digits are left, else ``content``."""
    c = F.coalesce(col(c), F.lit(""))
    s = strip_stamps(c, stamps)
    useful = n_useful(s)
    only = (s != c) & (useful < MIN_BEYOND_STAMPS)
    return F.struct(F.when(only, "stamp_only").otherwise("content").alias("yield"), useful.alias("useful"))


def text_quality(c: ColumnOrName) -> Column:
    """struct(score, needs_enrichment, reasons) of a page's text; a null text
    is judged as the empty one."""
    k = character_counts(F.coalesce(col(c), F.lit("")))
    n, useful, control = k["n"], k["useful"], k["control"]
    total = F.greatest(n, F.lit(1))
    tests = [
        ("too_few_useful_chars", useful < MIN_USEFUL),
        ("low_alnum_density", useful / total < 0.45),
        ("low_space_ratio", (n > 20) & (k["spaces"] / total < 0.04)),
        ("long_unseparated_sequence", (k["long_chars"] / total > 0.3) | ((k["long_n"] > 0) & (useful < 200))),
        ("gibberish_ratio_high", ((k["symbols"] + control) / total > 0.15) | (control >= 2)),
    ]
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))
    size = F.size(reasons)
    score = F.greatest(F.lit(0.0), F.round(F.lit(1.0) - size * F.lit(0.22), 2))
    return F.struct(score.alias("score"), (size > 0).alias("needs_enrichment"), reasons.alias("reasons"))


def dense_excerpt(c: ColumnOrName, most: int = 240) -> Column:
    """The start of a text without stamps; with them if under 40 characters
    are left; null if nothing is."""
    cut = lambda base: F.when(F.length(base) > most, F.concat(F.substring(base, 1, most), F.lit(" …"))).when(F.length(base) > 0, base)
    base = bound(collapse(strip_stamps(c)), lambda clean: F.when(F.length(clean) >= 40, clean).otherwise(collapse(c)))
    return bound(base, cut)


# ---------------------------------------------------------------- personal data and secrets

#: Masks in the order in which they are applied.
PERSONAL = (
    (r"\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4}", "[processo]"),
    (r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}", "[cnpj]"),
    (r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}", "[cpf]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]"),
)
#: Shapes of keys.
SECRETS = ((r"AIza[0-9A-Za-z_-]{20,}", "[REDACTED]"), (r"(?i)([?&]key=)[^&\s\"']+", "$1[REDACTED]"))


def quote(s: str) -> str:
    """A string as a regular expression that matches it."""
    return "".join("\\" + x if x in r".*+?^${}()|[]\-/#&~" else x for x in s)


def python_fold(s: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", s) if not "̀" <= x <= "ͯ").lower()


def _masked(c: Column, masks: tuple[tuple[str, str], ...]) -> Column:
    """Masks in their order.  A pattern with an @ is tried only on texts that
    hold one: masks don't bring any."""
    has_at, out = F.contains(c, F.lit("@")), c
    for pattern, mask in masks:
        made = F.regexp_replace(out, pattern, mask)
        out = F.when(has_at, made).otherwise(out) if "@" in pattern else made
    return out


def strip_personal(c: ColumnOrName, names: list[str] | tuple[str, ...] = (), masks=PERSONAL) -> Column:
    """Numbers and addresses of persons masked, then ``names`` of 4 characters
    or more in any case, as given and folded; white space runs collapsed."""
    c = _masked(col(c), masks)
    for name in names:
        name = name.strip()
        if len(name) >= 4:
            for variant in dict.fromkeys((name, python_fold(name))):
                c = F.regexp_replace(c, "(?iu)" + quote(variant), "[parte]")
    return F.trim(F.regexp_replace(c, SPACE + "{2,}", " "))


def strip_personal_names(c: ColumnOrName, names: Column, masks=PERSONAL) -> Column:
    """As ``strip_personal``, with an array column of names for each row."""
    c = _masked(col(c), masks)
    esc = lambda s: F.concat(F.lit("(?iu)"), F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    long = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: F.length(n) >= 4)
    both = F.flatten(F.transform(long, lambda n: F.array_distinct(F.array(n, fold(n)))))
    c = F.aggregate(both, c, lambda acc, n: F.regexp_replace(acc, esc(n), F.lit("[parte]")))
    return F.trim(F.regexp_replace(c, SPACE + "{2,}", " "))


def redact_secrets(c: ColumnOrName, known: list[str] | tuple[str, ...] = (), shapes=SECRETS) -> Column:
    """Key shapes and known secrets of 8 characters or more replaced."""
    c = col(c)
    for pattern, mask in shapes:
        c = F.regexp_replace(c, pattern, mask)
    for secret in known:
        if secret and len(secret) >= 8:
            c = F.replace(c, F.lit(secret), F.lit("[REDACTED]"))
    return c


# ---------------------------------------------------------------- literals, dates, money

#: Literals of a claim that its excerpts must hold.
LITERALS = (
    r"\d{2}/\d{2}/\d{4}",
    r"\d{4}-\d{2}-\d{2}",
    r"R\$\s?[\d.]+(?:,\d{2})?",
    r"\d+(?:,\d+)?\s?%",
    r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}",
)
DATE_RE = r"\b(\d{2})/(\d{2})/(\d{4})\b"


def literals(c: ColumnOrName, patterns: tuple[str, ...] = LITERALS) -> Column:
    """Literals pattern by pattern, in order of appearance."""
    return F.concat(*(F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in patterns))


def dates(c: ColumnOrName) -> Column:
    """dd/mm/yyyy as yyyy-mm-dd strings, not validated (99/99/2024 stays)."""
    found = F.regexp_extract_all(col(c), F.lit(DATE_RE), F.lit(0))
    return F.transform(found, lambda d: F.concat_ws("-", d.substr(7, 4), d.substr(4, 2), d.substr(1, 2)))


def date_is_valid(iso: ColumnOrName) -> Column:
    return F.try_to_date(col(iso)).isNotNull()


def brl(amount: ColumnOrName) -> Column:
    """R$ x,yy without thousands separators."""
    return F.concat(F.lit("R$ "), F.replace(F.format_string("%.2f", col(amount).cast("double")), F.lit("."), F.lit(",")))


def page_file_name(page: ColumnOrName) -> Column:
    return F.concat(F.lit("page-"), F.lpad(col(page).cast("string"), 6, "0"))


def first_match(c: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    c = col(c)
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def digits_only(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), r"\D", "")


def json_array(c: ColumnOrName) -> Column:
    """A JSON array of strings; anything else is the empty array."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))
