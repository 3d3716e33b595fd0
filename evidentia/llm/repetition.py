"""Quality rules by suffix-array repetition.

Per text a suffix array over its words is built by prefix doubling (many texts
at once, numpy); the longest common prefixes of neighbouring suffixes are
found by doubling steps over hashes of runs of words, in memory of a few
numbers a word.  A suffix's larger neighbouring prefix is
the longest LCP interval it lies in: a right-maximal repeat that starts there;
those that can't be extended to the left are the maximal repeats.  The union
of their spans and the longest of them are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import with_text_features
from .spark_util import documents
from .words import SEQ_BASES, WS, Words, chunks, mix, powers

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NOT_CODE_POINT = (np.arange(256) & 0xC0) == 0x80
IN_WORD_START = ~WS & ~NOT_CODE_POINT

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_maximal_repeats")]


def suffix_repeats(ids: np.ndarray, doc: np.ndarray, doc_end: np.ndarray, min_len: int) -> np.ndarray:
    """For each word, the length of the longest repeat (min_len words or more,
    within its text) that starts there, else 0.

    ids: a number for each word; doc: the word's text, ascending; doc_end: the
    index past the last word of the word's text.
    """
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    # rank: place in the suffix array of the first suffix of its group
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    sk = key[order]
    new = np.concatenate([[True], sk[1:] != sk[:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = first[group]
    size = np.diff(np.append(first, n))
    active = order[size[group] > 1]
    h = 1
    while len(active):
        nxt = active + h
        second = np.where(nxt < doc_end[active], rank[np.minimum(nxt, n - 1)], -1)
        r = rank[active]
        o = np.lexsort((second, r)) if n > 3_000_000_000 else np.argsort(r * (n + 1) + second + 1, kind="stable")
        active, r, second = active[o], r[o], second[o]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_sub = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        in_group = at - np.maximum.accumulate(np.where(new_group, at, 0))
        sub_first = np.maximum.accumulate(np.where(new_sub, at, 0))
        rank[active] = r + in_group[sub_first]
        sizes = np.diff(np.append(np.flatnonzero(new_sub), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
    # all ranks differ now: the suffix array is their inverse
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    del rank, order, group, sk, new
    fwd, back = powers(SEQ_BASES[0], n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64)) * fwd[:n], out=pre[1:])
    run = lambda at, k: (pre[at + k] - pre[at]) * back[at]
    # neighbours of one text that share min_len words or more
    last = np.maximum(sa[:-1], sa[1:])
    at = np.flatnonzero((doc[sa[:-1]] == doc[sa[1:]]) & (last + min_len <= doc_end[last]))
    at = at[run(sa[at], min_len) == run(sa[at + 1], min_len)]
    i, j = sa[at], sa[at + 1]
    del sa, last, at
    lcp = np.full(len(i), min_len, np.int64)
    room = doc_end[i] - np.maximum(i, j)
    for m in range(int(room.max()).bit_length() if len(i) else 0, -1, -1):
        more = np.flatnonzero(lcp + (1 << m) <= room)
        more = more[run(i[more] + lcp[more], 1 << m) == run(j[more] + lcp[more], 1 << m)]
        lcp[more] += 1 << m
    np.maximum.at(longest, i, lcp)
    np.maximum.at(longest, j, lcp)
    return longest


def _features(min_len: int):
    def features(texts: pa.Array) -> dict[str, pa.Array]:
        out = {f.name: np.zeros(len(texts), np.int64) for f in FIELDS}
        for i, j, data, off in chunks(texts):
            w = Words(data, off)
            cnt = w.counts()
            n = len(w.starts)
            out["n_words"][i:j] = cnt

            def per_doc(flags: np.ndarray, w=w) -> np.ndarray:
                c = np.concatenate([[0], np.cumsum(flags)])
                return c[w.doc_end] - c[w.doc_start]

            out["word_chars"][i:j] = per_doc(IN_WORD_START[w.buf])
            out["n_symbols"][i:j] = per_doc(SYMBOL[w.buf])
            raw = data.tobytes()
            for d in range(j - i):
                a, b = off[d], off[d + 1]
                if raw.find(b"\n", a, b) >= 0:
                    lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
                    out["n_dup_lines"][i + d] = len(lines) - len(set(lines))
            if n:
                _, ids = np.unique(w.hashes(), return_inverse=True)
                doc = np.repeat(np.arange(j - i), cnt)
                longest = suffix_repeats(ids, doc, np.repeat(w.woff[1:], cnt), min_len)
                at = np.flatnonzero(longest)
                # maximal: the repeat that starts one word earlier isn't this one, longer
                maximal = at[~((at > 0) & (longest[at - 1] == longest[at] + 1) & (doc[at - 1] == doc[at]))]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, maximal, 1)
                np.subtract.at(edge, maximal + longest[maximal], 1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                out["n_repeat_words"][i:j] = covered[w.woff[1:]] - covered[w.woff[:-1]]
                best = np.zeros(j - i, np.int64)
                np.maximum.at(best, doc[maximal], longest[maximal])
                out["longest_repeat"][i:j] = best
                out["n_maximal_repeats"][i:j] = np.bincount(doc[maximal], minlength=j - i)
        return {k: pa.array(v, pa.int64()) for k, v in out.items()}

    return features


def quality_rules(
    docs: DataFrame,
    min_words: int = 20,
    min_repeat: int = 8,
    max_covered: float = 0.30,
    max_longest: float = 0.20,
) -> DataFrame:
    """All rows and columns of ``docs`` plus the features, ``base_failed`` and
    ``kept``.

    n_repeat_words is the union of the spans of all maximal repeats of
    ``min_repeat`` words or more.  A text fails with fewer than ``min_words``
    words, with more than ``max_covered`` of its words covered, or when its
    longest repeat is more than ``max_longest`` of its words.  A null or empty
    text has no words and fails.  Repeated rows are judged alike; columns named
    like a feature are replaced.
    """
    out = with_text_features(docs, _features(min_repeat), FIELDS)
    n = F.col("n_words")
    base = (n < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * max_covered)) * n)
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("longest_repeat") <= F.lit(max_longest) * n))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition features and verdict of every document."""
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same by grouping windows.  A repeat of more than a fifth of the words is
#: a window of the next larger length that is there twice.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
f AS (SELECT *, len(t) AS n, greatest(8, floor(0.2::DOUBLE * len(t))::BIGINT + 1) AS l, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(t[i:i + 7], ' ') AS w FROM (SELECT rid, t, unnest(generate_series(1, n - 7)) AS i FROM f WHERE n >= 8)),
rep AS (SELECT rid, count(DISTINCT k) AS c FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS k FROM win SEMI JOIN (SELECT rid, w FROM win GROUP BY ALL HAVING count(*) > 1) x USING (rid, w)) GROUP BY rid),
b AS (SELECT f.*, coalesce(c, 0) AS c, n < 20 OR 100 * coalesce(c, 0) > 30 * n AS bad FROM f LEFT JOIN rep USING (rid)),
long AS (SELECT DISTINCT rid FROM (SELECT rid, md5(array_to_string(t[i:i + l - 1], ' ')) AS w FROM (SELECT rid, t, l, unnest(generate_series(1, n - l + 1)) AS i FROM b WHERE NOT bad AND c >= l)) GROUP BY rid, w HAVING count(*) > 1)
SELECT doc_id, n AS n_words, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(s, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, c AS n_repeat_words,
  bad AS base_failed, NOT bad AND long.rid IS NULL AS kept FROM b LEFT JOIN long USING (rid)"""
