"""Character counts of texts in one vectorised pass.

What the quality of a page is judged by are counts over character classes of
its collapsed text.  As regular expressions they are seven passes over every
text; here an Arrow batch is decoded once and all counts are sums over it.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL, USEFUL, SPACE, PLAIN, UNKNOWN = 0, 1, 2, 3, 255
LONG = 45
#: Punctuation of prose, white space, damaged characters and their escapes.
PLAIN_CHARS = ".,;:()/%-"
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0                　"
CONTROL_CHARS = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFD]
ESCAPE_RE = re.compile(rb"\\u(?:FFFD|0000|0001)")
COUNTS = ("n", "useful", "control", "spaces", "long_n", "long_chars", "symbols")

_classes = np.full(0x110000, UNKNOWN, np.uint8)
_classes[[ord(c) for c in PLAIN_CHARS]] = PLAIN
_classes[[ord(c) for c in SPACE_CHARS]] = SPACE
_control = np.zeros(0x110000, bool)
_control[CONTROL_CHARS] = True


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point: letters and numbers are useful; looked up the
    first time they are seen."""
    got = _classes[points]
    if (got == UNKNOWN).any():
        for p in np.unique(points[got == UNKNOWN]).tolist():
            _classes[p] = USEFUL if unicodedata.category(chr(p))[0] in "LN" else SYMBOL
        got = _classes[points]
    return got


def count_characters(texts: pa.Array, step_bytes: int = 4 << 20) -> dict[str, np.ndarray]:
    """COUNTS of each text after its runs of white space are made one space and
    trimmed: characters, letters and digits, damaged characters, spaces, runs
    of LONG or more other characters and what they hold, and characters that
    are neither letters, digits, spaces nor plain punctuation.  Null counts as
    empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + step_bytes, "right")) - 1)
        part = raw[off[i] : off[j]]
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        begins = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        at = begins[off[i : j + 1] - off[i]]
        kind = classes(points)

        def per_text(flags: np.ndarray, at=at) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(flags)])
            return c[at[1:]] - c[at[:-1]]

        dark = kind != SPACE
        # a run begins after white space or where a text begins, and ends alike
        first = dark.copy()
        first[1:] &= ~dark[:-1]
        edges = at[:-1][at[:-1] < len(dark)]
        first[edges] = dark[edges]
        starts = np.flatnonzero(first)
        n_dark = np.concatenate([[0], np.cumsum(dark)])
        sizes = np.diff(np.append(n_dark[starts], n_dark[-1]))
        long_at = starts[sizes >= LONG]
        marks = np.zeros(len(dark), np.int64)
        marks[long_at] = sizes[sizes >= LONG]
        words = per_text(first)
        damaged = per_text(_control[points])
        body = part.tobytes()
        if b"\\u" in body:
            bounds = (off[i : j + 1] - off[i]).tolist()
            damaged = damaged + np.array([len(ESCAPE_RE.findall(body, a, b)) for a, b in zip(bounds, bounds[1:])])
        out["spaces"][i:j] = np.maximum(words - 1, 0)
        out["n"][i:j] = per_text(dark) + out["spaces"][i:j]
        out["useful"][i:j] = per_text(kind == USEFUL)
        out["control"][i:j] = damaged
        out["long_n"][i:j] = per_text(marks > 0)
        out["long_chars"][i:j] = per_text(marks)
        out["symbols"][i:j] = per_text(kind == SYMBOL)
        i = j
    return out


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def character_counts(text: Column) -> Column:
    """struct of COUNTS; one Arrow pass however many fields are used."""

    @F.arrow_udf(SCHEMA)
    def counts(texts: pa.Array) -> pa.Array:
        got = count_characters(texts)
        return pa.StructArray.from_arrays([pa.array(got[c]) for c in COUNTS], names=list(COUNTS))

    return counts(text)
