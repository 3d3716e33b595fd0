"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each word is drawn from one of them, with
the likelihood of its character n-grams.  Expectation-maximisation estimates
the text's proportions; the set of languages is the one with the largest
likelihood less a penalty for each language.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import with_text_features
from .spark_util import documents
from .words import Words, chunks, mix

TABLE_BITS = 16
FOLDS = 5
#: Tasks that a language's sample is dealt to, at most.
SAMPLE_PARTS = 16


def word_ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 1- to 4-grams of the words, lower-cased in ASCII, with a
    mark at either end: (word index, table index)."""
    n = len(w.starts)
    lens = w.ends - w.starts
    size = lens + 2
    total = int(size.sum())
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(n), size)
    place = np.arange(total) - np.repeat(first, size)
    sym = np.full(total, 256, np.uint64)
    inner = (place > 0) & (place <= np.repeat(lens, size))
    sym[inner] = w.buf[(np.repeat(w.starts, size) + place - 1)[inner]]
    left = np.repeat(size, size) - place
    words, grams = [word[inner]], [sym[inner]]
    code = sym
    for k in (2, 3, 4):
        code = code[:-1] * np.uint64(257) + sym[k - 1 :] if len(code) > 1 else code[:0]
        ok = left[: len(code)] >= k
        words.append(word[: len(code)][ok])
        grams.append(code[ok] + np.uint64(k << 40))
    g = mix(np.concatenate(grams)) >> np.uint64(64 - TABLE_BITS)
    return np.concatenate(words), g.astype(np.int64)


def count_table(texts: pa.Array, lang: np.ndarray, n_langs: int) -> np.ndarray:
    table = np.zeros((n_langs, 1 << TABLE_BITS), np.int64)
    for i, j, data, off in chunks(texts, 1 << 19):
        w = Words(data, off, lower=True)
        if len(w.starts):
            word, g = word_ngrams(w)
            of = np.repeat(lang[i:j], w.counts())[word]
            np.add.at(table, (of, g), 1)
    return table


def train(labelled: DataFrame, max_rows_per_lang: int = 2000, max_chars_per_row: int = 200_000, max_langs: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and the table of log-likelihoods (n-gram, language).

    labelled: (doc_id, text, lang).  The sample is bounded: of each language
    about ``max_rows_per_lang`` rows, those with the smallest hash of doc_id
    and text, among those whose text isn't longer than ``max_chars_per_row``.
    Rows with a null text or lang aren't used; repeated rows count as often as
    they are there.  Counts are summed on the executors, at most SAMPLE_PARTS
    tables to one of a language; the driver gets one table of 512 KB per
    language, and more than ``max_langs`` languages raise ValueError.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= max_chars_per_row)).select("doc_id", "text", "lang")
    keyed = rows.withColumn("_h", F.xxhash64("doc_id", "text", F.lit(5)))
    # the sample's bound by hash: per language, the share of the hash space that holds the wanted rows
    n = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(n) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(n)
    if not langs:
        return [], np.zeros((1 << TABLE_BITS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_rows_per_lang / n[lang]))])
    unit = F.pmod(F.col("_h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = keyed.filter(unit < F.element_at(share, F.col("lang"))).withColumn("_p", F.pmod(F.shiftright("_h", 32), F.lit(SAMPLE_PARTS)))

    def count(key, rows):
        t = count_table(rows.column("text").combine_chunks(), np.zeros(rows.num_rows, np.int64), 1)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "t": pa.array([t.tobytes()], pa.binary())})

    def add(key, rows):
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("t"))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "t": pa.array([total.tobytes()], pa.binary())})

    parts = sample.select("lang", "_p", "text").groupBy("lang", "_p").applyInArrow(count, "lang string, t binary")
    counts = np.zeros((len(langs), 1 << TABLE_BITS))
    for r in parts.groupBy("lang").applyInArrow(add, "lang string, t binary").collect():
        counts[langs.index(r["lang"])] = np.frombuffer(r["t"], np.int64)
    prior = counts.sum(0) + 0.5
    prior /= prior.sum()
    smooth = 2.0 * len(prior) ** 0.5
    like = (counts + smooth * prior) / (counts.sum(1, keepdims=True) + smooth)
    return langs, np.log(like).T.astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (text, language) and log-likelihood of each text.  like:
    (word, language), scaled so that a word's best is 1; every text has words;
    start: the first proportions, 0 where a language isn't in the set."""
    n = np.diff(np.append(first, len(like)))[:, None]
    pi = start / start.sum(1, keepdims=True)
    for _ in range(rounds):
        resp = like * pi[doc]
        resp /= np.maximum(resp.sum(1, keepdims=True), 1e-30)
        pi = np.add.reduceat(resp, first, axis=0) / n
    ll = np.add.reduceat(np.log(np.maximum((like * pi[doc]).sum(1), 1e-30)), first)
    return pi, ll


def infer(texts: pa.Array, langs: Sequence[str], table: np.ndarray, rounds: int = 6, penalty: float = 6.0):
    """Language set, its first language and that one's proportion for each text.

    Tried are the languages of the largest proportions, in every number up to
    all of them.  A likelihood is at most 1, so a text is done when the penalty
    alone makes any larger set worse than its best: no set that could win is
    left out.
    """
    n = len(texts)
    pred, score, sets = np.full(n, None, object), np.zeros(n), np.full(n, None, object)
    k = len(langs)
    for i, j, data, off in chunks(texts, 1 << 18):
        w = Words(data, off, lower=True)
        has = np.array([any(c.isalpha() for c in x) if x is not None else False for x in (t.as_py() for t in texts[i:j])])
        doc = np.repeat(np.arange(j - i), w.counts())
        if not len(doc) or not k:
            continue
        h, at, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
        few = Words.__new__(Words)
        few.buf, few.starts, few.ends = w.buf, w.starts[at], w.ends[at]
        word, g = word_ngrams(few)
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(len(at)))
        ll = np.add.reduceat(table[g[order]].astype(np.float64), bounds, axis=0)
        ll /= 3.0  # overlapping n-grams count a character about that often
        like = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -50.0))[inv]
        some = np.flatnonzero(w.counts() > 0)
        first = w.woff[some]
        dense = np.cumsum(w.counts() > 0) - 1
        doc = dense[doc]
        pi, _ = _em(like, doc, first, np.ones((len(some), k)), rounds)
        rank = np.argsort(-pi, axis=1, kind="stable")
        best, best_pi, best_n = np.full(len(some), -np.inf), pi.copy(), np.ones(len(some), int)
        n_words, left = np.diff(np.append(first, len(like))), np.arange(len(some))
        for size in range(1, k + 1):
            more = best[left] < -penalty * size
            if not more.any():
                break
            if not more.all():
                rows = more[doc]
                like, doc = like[rows], (np.cumsum(more) - 1)[doc[rows]]
                left, n_words = left[more], n_words[more]
                first = np.cumsum(n_words) - n_words
            allowed = np.zeros((len(left), k))
            np.put_along_axis(allowed, rank[left, :size], 1.0, axis=1)
            p, l2 = _em(like, doc, first, allowed * (pi[left] + 0.01), rounds // 2 if size > 1 else 0)
            l2 = l2 - penalty * size
            win = l2 > best[left]
            at = left[win]
            best[at], best_pi[at], best_n[at] = l2[win], p[win], size
        order = np.argsort(-best_pi, axis=1, kind="stable")
        for d, s in enumerate(some):
            if has[s]:
                pred[i + s] = langs[order[d, 0]]
                score[i + s] = min(1.0, max(0.0, best_pi[d, order[d, 0]]))
                sets[i + s] = [langs[x] for x in order[d, : best_n[d]]]
    return pred, score, sets


def identify(docs: DataFrame, langs: Sequence[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``lang_pred``, ``score`` (the
    proportion of that language) and ``lang_set``.

    A null text, one without a letter, or any text when nothing was learned is
    ``und`` with score 0 and an empty set.  Repeated rows get equal values;
    columns of those names are replaced.
    """
    bc = docs.sparkSession.sparkContext.broadcast((list(langs), table))  # languages x 2**TABLE_BITS floats

    def features(texts: pa.Array) -> dict[str, pa.Array]:
        names, tab = bc.value
        pred, score, sets = infer(texts, names, tab)
        return {
            "lang_pred": pa.array(["und" if p is None else p for p in pred], pa.string()),
            "score": pa.array(score, pa.float64()),
            "lang_set": pa.array([[] if s is None else s for s in sets], pa.list_(pa.string())),
        }

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType()))]
    return with_text_features(docs, features, fields, text)


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    docs = documents(spark, sf_dir)
    # a null doc_id has no text to hash; it counts as the empty one
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS) == 0
    langs, table = train(docs.filter(~held).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), langs, table)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.concat_ws(",", "lang_set").alias("lang_set"))
