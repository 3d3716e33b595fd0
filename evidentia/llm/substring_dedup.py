"""Substring deduplication with a count-min prefilter.

Pass 1: each block of documents makes a count-min sketch of its windows (k
consecutive words); the sketches are merged cell by cell, and each block gets
back which of its windows are estimated to be repeated.  A sketch is never
below the true count, so no repeated window is lost.  Pass 2: only those
windows, by 128-bit hashes of their words, are grouped exactly, and each block
learns which of its first occurrences is the first of all.  Pass 3 removes the
words that a window covers which also starts earlier.

The sketch's width follows the number of windows (a fixed one would estimate
everything as repeated at scale), so it is merged and answered slice by slice
and never held or broadcast as a whole; see block_lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import tidy
from .block_lists import ANSWER, COARSE_BITS, FAN, LIST, answer_table, answers, count_answers, deltas, list_table, lists_of, n_blocks_for, planes, slice_runs, slices_for, small_numbers, undeltas, unplanes
from .spark_util import documents, text_chars
from .words import Words, chunks, mix, ranges, sequence_hashes

U64 = np.uint64
LEAST = -(1 << 63)


class Windows:
    """The windows of a block, its documents ordered by doc_id (null first)."""

    def __init__(self, table: pa.Table, k: int):
        ids = table.column("doc_id").combine_chunks()
        doc = np.asarray(ids.fill_null(LEAST).cast(pa.int64()))
        self.order = np.argsort(doc, kind="stable")
        self.doc_id = doc[self.order]
        self.texts = table.column("text").combine_chunks().take(pa.array(self.order))
        parts, first_word = [], 0
        self.word_counts = np.zeros(len(doc), np.int64)
        for i, j, data, off in chunks(self.texts):
            w = Words(data, off)
            cnt = w.counts()
            self.word_counts[i:j] = cnt
            n = np.maximum(cnt - k + 1, 0)
            at = ranges(w.woff[:-1], n)
            h = w.hashes()
            parts.append((sequence_hashes(h, at, k, 0), sequence_hashes(h, at, k, 1), np.repeat(np.arange(i, j), n), at - np.repeat(w.woff[:-1], n), at + first_word))
            first_word += len(w.starts)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts)] or [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 3
        self.h1, self.h2, self.doc, self.start, self.word = cols
        # windows by hash, then by place: the first of a run is the block's first occurrence
        self.by_hash = np.argsort(self.h1, kind="stable")
        a, b = self.h1[self.by_hash], self.h2[self.by_hash]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # windows that differ in the second half alone
            self.by_hash = np.lexsort((self.h2, self.h1))
            a, b = self.h1[self.by_hash], self.h2[self.by_hash]
        self.new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        self.group = np.cumsum(self.new) - 1
        self.head = np.flatnonzero(self.new)  # of each distinct window, in by_hash
        self.u1, self.u2 = a[self.head], b[self.head]
        self.size = np.diff(np.append(self.head, len(a)))


class Sketch:
    """Rows of a count-min sketch: width cells each, a cell of a window by the
    first bits of its first hash, and in further rows by hashes of it."""

    def __init__(self, windows: int, depth: int, cells_per_window: int):
        self.depth = depth
        self.bits = max(10, (max(1, windows) * cells_per_window - 1).bit_length())
        self.n_slices = min(slices_for(windows), 1 << (self.bits - 1))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        if row:
            h = mix(h + U64(0x9E3779B97F4A7C15 * row & (2**64 - 1)))
        return h >> U64(64 - self.bits)


def _block_cells(h: np.ndarray, copies: np.ndarray, sk: Sketch, row: int):
    """Distinct cells of a block's distinct windows (ascending), ascending;
    whether each holds two or more windows of the block; each window's index
    among them."""
    cells = sk.cells(h, row)
    if row:
        u, inv = np.unique(cells, return_inverse=True)
    else:  # in order already
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        u, inv = cells[new], np.cumsum(new) - 1
    many = np.bincount(inv, copies, minlength=len(u)) >= 2
    return u, many, inv


def _send_sketch(sk: Sketch, k: int):
    def run(key, table):
        w = Windows(table, k)
        cells = ((str(row), *_block_cells(w.u1, w.size, sk, row)) for row in range(sk.depth))
        return lists_of([(key[0].as_py(), kind, u, 1 + many) for kind, u, many, _ in cells], sk.bits, sk.n_slices)

    return run


def _candidates(w: Windows, sk: Sketch, side: pa.Table) -> np.ndarray:
    """Distinct windows of the block whose every cell is estimated repeated."""
    ok = np.ones(len(w.u1), bool)
    for row in range(sk.depth):
        u, _, inv = _block_cells(w.u1, w.size, sk, row)
        if len(u):
            ok &= (answers(side, str(row)) > 0)[inv]
    return np.flatnonzero(ok)


# ---------------------------------------------------------------- exact grouping


def _place_lists(block: int, n_slices: int, h1, h2, doc, start) -> list[tuple]:
    """Windows by ascending h1, with the place of each, as rows of LIST."""
    out = []
    for s, a, b in slice_runs(h1, 64, n_slices):
        extra = [h2[a:b].tobytes(), planes(doc[a:b]), planes(start[a:b])]
        head = np.array([len(x) for x in extra], "<u4").tobytes()
        out.append((block, s, "exact", deltas(h1[a:b]), head + b"".join(extra)))
    return out


class _Places:
    """The windows of several lists, in order of hashes, then of place."""

    def __init__(self, table: pa.Table):
        h1, h2, doc, start = [], [], [], []
        for p, x in zip(table.column("payload").to_pylist(), table.column("extra").to_pylist()):
            n = np.frombuffer(x, "<u4", 3)
            a, b = 12 + int(n[0]), 12 + int(n[0]) + int(n[1])
            h1.append(undeltas(p))
            h2.append(np.frombuffer(x[12:a], U64))
            doc.append(unplanes(x[a:b]))
            start.append(unplanes(x[b:]))
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in h1])])
        cols = [np.concatenate(x) for x in (h1, h2, doc, start)]
        self.order = np.lexsort(cols[::-1])
        self.cols = [x[self.order] for x in cols]
        a, b, doc, start = self.cols
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.first, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        f = self.first[self.group]
        self.later = (doc != doc[f]) | (start != start[f])

    def answer(self, table: pa.Table, later: np.ndarray) -> pa.Table:
        flags = np.empty(len(later), np.int64)
        flags[self.order] = later
        return answer_table([(b, s, "exact", small_numbers(flags[self.at[i] : self.at[i + 1]])) for i, (b, s) in enumerate(zip(table.column("block").to_pylist(), table.column("slice").to_pylist()))])


def _send_candidates(sk: Sketch, k: int, n_slices: int):
    """The candidates with their places; and, in a slice of the block's own,
    which of its distinct windows they are, for the last pass."""

    def run(key, table, side):
        if not table.num_rows:
            return list_table([])
        w, block = Windows(table, k), key[0].as_py()
        c = _candidates(w, sk, side)
        first = w.by_hash[w.head[c]]
        doc = w.doc_id[w.doc[first]].astype(np.int64).view(U64) ^ U64(1 << 63)
        flags = np.zeros(len(w.u1), bool)
        flags[c] = True
        own = (block, -1 - block, "own", np.packbits(flags).tobytes(), b"")
        return list_table([own, *_place_lists(block, min(n_slices, 1 << COARSE_BITS), w.u1[c], w.u2[c], doc, w.start[first].astype(U64))])

    return run


def _merge_candidates(sent: DataFrame, n_slices: int) -> DataFrame:
    """The answer for each window sent: does it start earlier elsewhere?  In
    two levels where there are many slices, as ``count_answers``.  A block's own
    slice (below 0) is handed back to it."""

    def own(table):
        return answer_table(list(zip(*(table.column(c).to_pylist() for c in ("block", "slice", "kind", "payload")))))

    def merge(key, table):
        if key[0].as_py() < 0:
            return own(table)
        x = _Places(table)
        return x.answer(table, x.later)

    if n_slices <= 1 << COARSE_BITS:
        return sent.groupBy("slice").applyInArrow(tidy(merge), ANSWER)

    down = n_slices.bit_length() - 1 - COARSE_BITS

    def earliest(key, table):
        g, s = key[0].as_py(), key[1].as_py()
        if s < 0:
            return list_table([(g, s, "own", b"", b"")])
        x = _Places(table)
        return list_table(_place_lists(g, n_slices, *(c[x.first] for c in x.cols)))

    def hand_down(key, table, side):
        if key[1].as_py() < 0:
            return own(table)
        x = _Places(table)
        return x.answer(table, x.later | (answers(side, "exact") > 0)[x.group])

    lists = sent.withColumn("g", F.floor(F.col("block") / F.lit(FAN)).cast("int"))
    fine = lists.groupBy("g", "slice").applyInArrow(tidy(earliest), LIST).groupBy("slice").applyInArrow(tidy(merge), ANSWER)
    back = fine.withColumn("coarse", F.when(F.col("slice") < 0, F.col("slice")).otherwise(F.shiftright("slice", down)))
    return lists.groupBy("g", "slice").cogroup(back.groupBy("block", "coarse")).applyInArrow(tidy(hand_down), ANSWER)


def _remove(k: int, names: list[str]):
    def run(key, table, side):
        if not table.num_rows:
            return table.select(names).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept_text", pa.array([], pa.string()))
        w = Windows(table, k)
        flags = b"".join(p for kind, p in zip(side.column("kind").to_pylist(), side.column("payload").to_pylist()) if kind == "own")
        c = np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(w.u1)))
        later = answers(side, "exact") > 0
        # of a distinct window: is its first occurrence here removed as well?
        first_goes = np.zeros(len(w.u1), bool)
        first_goes[c] = later
        g = w.group
        head = w.by_hash[w.head]
        same_place = (w.doc_id[w.doc[w.by_hash]] == w.doc_id[w.doc[head[g]]]) & (w.start[w.by_hash] == w.start[head[g]])
        gone = w.by_hash[first_goes[g] | ~same_place]
        total = int(w.word_counts.sum())
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, w.word[gone], 1)
        np.subtract.at(edge, w.word[gone] + k, 1)
        keep = np.cumsum(edge[:-1]) <= 0
        kept, first = [], 0
        for _, _, data, off in chunks(w.texts):
            words = Words(data, off)
            n = len(words.starts)
            kept.append(words.join_kept(keep[first : first + n]))
            first += n
        csum = np.concatenate([[0], np.cumsum(~keep)])
        bounds = np.concatenate([[0], np.cumsum(w.word_counts)])
        out = table.select(names).take(pa.array(w.order))
        out = out.append_column("n_words", pa.array(w.word_counts, pa.int64()))
        out = out.append_column("n_removed", pa.array(csum[bounds[1:]] - csum[bounds[:-1]], pa.int64()))
        return out.append_column("kept_text", pa.chunked_array(kept, pa.string()))

    return run


def substring_dedup(docs: DataFrame, k: int = 20, depth: int = 2, cells_per_window: int = 4, block_bytes: int = 6 << 20) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id integer, text, ...) plus
    ``n_words``, ``n_removed`` and ``kept_text``, the words no removed window
    covers, joined by one space.

    A window of ``k`` words is removed if its words also start earlier: in a
    smaller doc_id, or earlier in the same document.  A null text has no words
    and gives an empty ``kept_text``.  A null doc_id counts as the least long.
    Rows with equal doc_id count as one document: what starts at the same word
    of it is at the same place, so repeated rows stay alike.  Input columns
    named like a result are replaced.
    """
    made = ("n_words", "n_removed", "kept_text")
    names = [c for c in docs.columns if c not in made]
    chars = text_chars(docs)
    windows = max(1, chars // 5)  # words are longer on the whole; only sets sizes
    sk = Sketch(windows, depth, cells_per_window)
    n_slices = slices_for(max(1, windows // 3))
    n_blocks = n_blocks_for(chars, block_bytes)
    # one exchange of the texts, used by all three passes; rows of one id are apart unless their texts are equal
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    rows = docs.select(*names, block.alias("_block")).repartition("_block")
    sent = rows.groupBy("_block").applyInArrow(tidy(_send_sketch(sk, k)), LIST)
    repeated = count_answers(sent, sk.bits, sk.n_slices, lambda n: n >= 2)
    exact = rows.groupBy("_block").cogroup(repeated.groupBy("block")).applyInArrow(tidy(_send_candidates(sk, k, n_slices)), LIST)
    first = _merge_candidates(exact, n_slices)
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.groupBy("_block").cogroup(first.groupBy("block")).applyInArrow(tidy(_remove(k, names)), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier."""
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same by joins over whole windows.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(t[i:i + 19], ' ') AS w FROM (SELECT *, unnest(generate_series(1, len(t) - 19)) AS i FROM d WHERE len(t) >= 20)),
seen AS (SELECT w, min((doc_id, i)) AS first FROM win GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 19)) AS k FROM win JOIN seen USING (w) WHERE (doc_id, i) <> first),
words AS (SELECT rid, unnest(t) AS word, generate_subscripts(t, 1) AS k FROM d),
kept AS (SELECT words.rid, string_agg(word, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS s, count(gone.k) AS n FROM words LEFT JOIN gone ON gone.rid = words.rid AND gone.k = words.k GROUP BY words.rid)
SELECT doc_id, len(t) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""
