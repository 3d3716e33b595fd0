"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector w for all
grades, x the hashed features of the text, and ordered thresholds (the first,
and positive steps).  Scoring gives the expected grade and the tail
probabilities P(grade >= k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import with_text_features
from .spark_util import documents
from .words import LOWER, WS, Words, chunks, mix

BITS = 18
#: Least probability of the top grade that keeps a document.
KEEP_FROM = 0.25
#: Classes of bytes for word shapes: lower, upper, digit, multi-byte, and the other bytes as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows of the texts: offsets, hashed indices, values.

    Each distinct word (ASCII lower case, outer punctuation dropped) has value
    1.  Each word shape, and a word
    equal to the one before, has 4 times its share of the words.
    """
    counts, indices, values = [], [], []
    for _, _, data, off in chunks(texts):
        w = Words(data, off)
        n_docs, cnt = len(off) - 1, w.counts()
        doc = np.repeat(np.arange(n_docs), cnt)
        rows_d, rows_i, rows_v = [], [], []
        if len(doc):
            raw = w.hashes()
            again = np.zeros(len(raw), bool)
            again[1:] = (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])
            plain = Words.__new__(Words)
            plain.buf, plain.starts, plain.ends = LOWER[w.buf], w.starts, w.ends
            # drop punctuation at the ends of words, if anything stays
            core = ((w.buf >= 48) & (w.buf < 58)) | ((plain.buf >= 97) & (plain.buf < 123)) | (w.buf >= 128)
            cc = np.concatenate([[0], np.cumsum(core)])
            at = np.flatnonzero(core)
            some = cc[w.ends] > cc[w.starts]
            plain.starts, plain.ends = w.starts.copy(), w.ends.copy()
            plain.starts[some] = at[cc[w.starts[some]]]
            plain.ends[some] = at[cc[w.ends[some]] - 1] + 1
            shaped = Words.__new__(Words)
            sb = SHAPE[w.buf]
            run = np.ones(len(sb), bool)
            run[1:] = (sb[1:] != sb[:-1]) | WS[sb[1:]]
            pos = np.concatenate([[0], np.cumsum(run)])
            shaped.buf, shaped.starts = sb[run], pos[w.starts]
            shaped.ends = np.maximum(pos[w.ends], shaped.starts + 1)
            share = 4.0 / np.maximum(cnt, 1)
            for h, salt, kind in ((plain.hashes(), 1, "word"), (shaped.hashes(), 2, "shape"), (np.full(int(again.sum()), 7, np.uint64), 3, "again")):
                d = doc[again] if kind == "again" else doc
                g = (mix(h + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)
                key, n = np.unique(d << BITS | g, return_counts=True)
                kd = key >> BITS
                rows_d.append(kd), rows_i.append(key & ((1 << BITS) - 1))
                rows_v.append(np.ones(len(kd)) if kind == "word" else n * share[kd])
            d = np.concatenate(rows_d)
            o = np.argsort(d, kind="stable")
            counts.append(np.bincount(d, minlength=n_docs))
            indices.append(np.concatenate(rows_i)[o]), values.append(np.concatenate(rows_v)[o])
        else:
            counts.append(np.zeros(n_docs, np.int64))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    off = np.concatenate([[0], np.cumsum(cat(counts, np.int64))]).astype(np.int64)
    return off, cat(indices, np.int64), cat(values, np.float64)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one less than the grades

    def margins(self, off: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(self.weights[idx] * val)])
        return c[off[1:]] - c[off[:-1]]

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... (text, k)."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -40, 40)))


def fit_ordinal(off: np.ndarray, idx: np.ndarray, val: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 300, l1: float = 1e-3, step: float = 0.3, min_rows: int = 8) -> OrdinalModel:
    """Maximum likelihood less ``l1`` times the weights' absolute sum, by
    full-batch proximal AdaGrad; each grade has equal weight.  Features of fewer than ``min_rows`` rows keep weight 0."""
    size = 1 << BITS
    common = np.bincount(idx, minlength=size) >= min_rows
    val = np.where(common[idx], val, 0.0)
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    # theta_0, then log-steps: thresholds stay ordered
    a, a2 = np.concatenate([[-0.5], np.zeros(n_grades - 2)]), np.full(n_grades - 1, 1e-8)
    row = np.repeat(np.arange(len(grade)), np.diff(off))
    weight = 1.0 / np.maximum(np.bincount(grade, minlength=n_grades), 1)[grade]
    weight /= weight.sum()
    for _ in range(rounds):
        th = a[0] + np.concatenate([[0.0], np.cumsum(np.exp(a[1:]))])
        m = np.bincount(row, w[idx] * val, minlength=len(grade))
        s = 1.0 / (1.0 + np.exp(np.clip(m[:, None] - th[None, :], -40, 40)))  # P(grade <= k)
        full = np.concatenate([np.zeros((len(m), 1)), s, np.ones((len(m), 1))], axis=1)
        at = np.arange(len(m))
        hi, lo = full[at, grade + 1], full[at, grade]
        p = np.maximum(hi - lo, 1e-12)
        d = full * (1 - full)
        dm = -weight * (-(d[at, grade + 1] - d[at, grade])) / p  # of minus log-likelihood by the margin
        gw = np.bincount(idx, dm[row] * val, minlength=size)
        dth = np.zeros((len(m), n_grades + 1))
        dth[at, grade + 1] -= weight * d[at, grade + 1] / p
        dth[at, grade] += weight * d[at, grade] / p
        gth = dth[:, 1:-1].sum(0)
        ga = np.concatenate([[gth.sum()], [gth[k + 1 :].sum() * np.exp(a[k + 1]) for k in range(n_grades - 2)]])
        g2 += gw * gw
        a2 += ga * ga
        rate = step / np.sqrt(g2)
        w -= rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0.0)
        a -= step * ga / np.sqrt(a2)
    return OrdinalModel(w, a[0] + np.concatenate([[0.0], np.cumsum(np.exp(a[1:]))]))


def train(rated: DataFrame, docs: DataFrame, n_grades: int, max_rows_per_grade: int = 2500, max_chars_per_row: int = 50_000) -> OrdinalModel:
    """Fit on a bounded sample of the rated documents.

    rated: (doc_id, grade); docs: (doc_id, text).  Of each grade about
    ``max_rows_per_grade`` ratings are used, those with the smallest hash of
    doc_id, among texts of at most ``max_chars_per_row`` characters; that is
    all the driver ever holds.  Rows with a null id, grade or text aren't used;
    equal ratings count once, and a doc_id with several texts counts with the
    first of them.  Without ratings the model has no weights.
    """
    rated = rated.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).select("doc_id", F.col("grade").cast("int").alias("grade")).distinct()
    n = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for k, c in n.items():
        share = F.when(F.col("grade") == k, F.lit(min(1.0, max_rows_per_grade / c))).otherwise(share)
    sample = rated.filter(unit < share)
    texts = docs.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars_per_row)).select("doc_id", "text")
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")

    def features(batches):
        for b in batches:
            off, idx, val = text_features(b.column("text"))
            cells = [(idx[off[i] : off[i + 1]].astype("<i4").tobytes(), val[off[i] : off[i + 1]].astype("<f4").tobytes()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["grade", "i", "v"])

    got = rows.mapInArrow(features, "grade int, i binary, v binary").toArrow()
    if not got.num_rows:
        return OrdinalModel(np.zeros(1 << BITS), np.arange(n_grades - 1) - (n_grades - 2) / 2.0)
    order = sorted(range(got.num_rows), key=lambda k: (got["grade"][k].as_py(), got["i"][k].as_py()))  # the same sums whatever the order of arrival
    idx = [np.frombuffer(got["i"][k].as_py(), "<i4") for k in order]
    val = [np.frombuffer(got["v"][k].as_py(), "<f4") for k in order]
    off = np.concatenate([[0], np.cumsum([len(x) for x in idx])])
    grade = np.array([got["grade"][k].as_py() for k in order])
    return fit_ordinal(off, np.concatenate(idx).astype(np.int64), np.concatenate(val).astype(np.float64), grade, n_grades)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``expected_grade`` and ``tail_1``,
    ``tail_2``, ...: P(grade >= k).

    A null or empty text has no features, so its probabilities are those of
    the thresholds alone.  Equal texts score alike; columns of those names are
    replaced.
    """
    k = len(model.thresholds)
    bc = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def features(texts: pa.Array) -> dict[str, pa.Array]:
        m = bc.value
        tails = m.tails(m.margins(*text_features(texts)))
        return {"expected_grade": pa.array(tails.sum(1))} | {f"tail_{j + 1}": pa.array(tails[:, j]) for j in range(k)}

    return with_text_features(docs, features, [T.StructField(c, T.DoubleType()) for c in ("expected_grade", *(f"tail_{j + 1}" for j in range(k)))], text)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Ratings of the labels as grades: 0 toxic, 1 of low quality, 2 good; null
    where neither says enough."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document; kept are those
    with at least KEEP_FROM probability of the top grade."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")), docs, 3)
    out = score(docs, model)
    return out.select("doc_id", "expected_grade", "tail_1", "tail_2", (F.col("tail_2") >= KEEP_FROM).alias("kept"))
