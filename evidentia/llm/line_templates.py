r"""Line dedup with a log-template tree.

Lines (between ``\n``) are parsed by a tree of fixed depth: the first level is
the number of tokens, the next ones the leading tokens, each by its own child
or by the wildcard child.  Of the paths whose leaf holds lines of ``min_docs``
documents or more, a line takes the one with the fewest wildcards (of those the
fullest one).  A token with a digit is a number field from the start.

A line is in its leaf only if enough of its pairs of neighbouring tokens (places
1 and 2, 3 and 4, ...) are found in ``min_docs`` documents at that place of as
long lines: a template leaves a pair whole for all but 30 % of the tokens.

A leaf generalises what varies: a token that fewer than ``min_docs`` of its
documents have at that place is a field.  The other tokens become fields too,
the rarest first, as long as at most 30 % of the tokens are fields and half are
literal; so a line has a chain of ever more general templates, and fields may
stand anywhere, also where some of their values are frequent.  A template recurs
if it is found in ``min_docs`` documents; lines of recurring templates are
dropped from all documents.

Documents with equal texts count as one, and a line counts once for a document,
so whole copies and repeats inside one text are left to other operators.

The three steps (leaves and pairs, tokens of a leaf, templates) are counts of keys over
blocks of documents (see block_lists), and what the second step finds out about a line
is handed on to the third: no leaf is gathered, the order of lines
is of no account, and a leaf or template of any frequency is one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import tidy
from .block_lists import ANSWER, LIST, answers, count_answers, list_table, lists_of, n_blocks_for, slices_for, sorted_counts
from .spark_util import cut, documents
from .words import SEQ_BASES, Words, chunks, mix, powers, ranges

U64 = np.uint64
NUMBER, WILD = "<*>", "<?>"
#: The kind of a block's row that hands its lines' leaves on.
LEAVES = "leaves"
NUMBER_HASH, WILD_HASH = Words(np.frombuffer((NUMBER + WILD).encode(), np.uint8), np.array([0, 3, 6])).hashes()
LENGTH = U64(0xD1342543DE82EF95)
MADE = ("n_lines", "n_dropped", "n_words", "n_words_dropped", "kept_text")


def _masks(depth: int) -> list[int]:
    """Which of the leading tokens are wildcards, the fewest first; not all."""
    return sorted(range((1 << depth) - 1), key=lambda m: (m.bit_count(), m))


class Tree:
    """The lines with a token of a block: text ``doc``, place ``at`` in it,
    number ``n`` of tokens; the tokens' hashes ``h``, and each line's ``first``
    token among them."""

    def __init__(self, texts: pa.Array, depth: int):
        parts = [self._parse(i, data, off) for i, _, data, off in chunks(texts)]
        doc, at, n, h = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
        self.doc, self.at, self.n, self.h, self.depth = doc, at, n, h.astype(U64), depth
        self.first = np.cumsum(n) - n
        self.base = powers(SEQ_BASES[0], int(n.max()) + 1 if len(n) else 1)[0]

    @staticmethod
    def _parse(i: int, data: np.ndarray, off: np.ndarray):
        w = Words(data, off)
        n_words = len(w.starts)
        # a line begins with the first word of a text or after a newline
        newline = np.flatnonzero(w.buf == 0x0A)
        first = np.union1d(w.woff[:-1], np.searchsorted(w.starts, newline))
        first = first[first < n_words]
        of = np.searchsorted(w.woff, first, "right") - 1
        at = np.searchsorted(newline, w.starts[first]) - np.searchsorted(newline, w.doc_start[of])
        h = w.hashes()
        h[h == WILD_HASH] = NUMBER_HASH
        h[np.searchsorted(w.starts, np.flatnonzero((w.buf >= 48) & (w.buf < 58)), "right") - 1] = NUMBER_HASH
        return of + i, at, np.diff(np.append(first, n_words)), h

    def paths(self) -> np.ndarray:
        """Keys (line, mask) of the paths of each line, 0 for none."""
        masks = _masks(self.depth)
        sums = np.zeros((len(self.n), len(masks) + 1), U64)
        for k in range(self.depth):
            has = np.flatnonzero(self.n > k)
            token = self.h[self.first[has] + k]
            for q, m in enumerate([*masks, (1 << self.depth) - 1]):
                sums[has, q] += token * self.base[k] if not m >> k & 1 else self.base[k : k + 1] * WILD_HASH
        keys = np.maximum(mix(sums + (self.n.astype(U64) * LENGTH)[:, None]), U64(1))
        self.wild = keys[:, -1]
        levels = np.minimum(self.n, self.depth)
        for q, m in enumerate(masks):
            keys[m >= (1 << levels) - 1, q] = 0
        return keys[:, :-1]

    @staticmethod
    def _places(lines: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line and place of ``n`` tokens of each of the lines."""
        return np.repeat(lines, n), ranges(np.zeros(len(n), np.int64), n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs of tokens at even places, and the line of each."""
        line, place = self._places(np.arange(len(self.n)), self.n // 2)
        place *= 2
        at = self.first[line] + place
        where = mix((self.n[line] << 32 | place).astype(U64))
        return np.maximum(mix(self.h[at] * self.base[0] + self.h[at + 1] * powers(SEQ_BASES[0], 2)[0][1] + where), U64(1)), line

    def take_leaves(self, keys: np.ndarray, count: np.ndarray, whole: np.ndarray) -> None:
        """count: documents of each path, 0 if there are too few; whole: pairs
        of each line that are in enough documents."""
        masks = np.array(_masks(self.depth))
        bits = np.array([m.bit_count() for m in masks.tolist()])
        score = np.where(count > 0, (self.depth - bits << 40) + count, 0)
        best = score.argmax(axis=1)
        each = np.arange(len(self.n))
        found = score[each, best] > 0 if len(each) else np.zeros(0, bool)
        levels = np.minimum(self.n, self.depth)
        mask = np.where(found, masks[best], (1 << levels) - 1)
        self.leaf = np.where(found, keys[each, best], self.wild)
        self.mask = mask
        self._settle(np.flatnonzero(whole >= self.n // 2 - 3 * self.n // 10))

    def _settle(self, lines: np.ndarray) -> None:
        """What the templates of these lines are made of, by their leaves."""
        # wild leading tokens, literal ones, and numbers that are not wild
        able = np.zeros(len(self.n), bool)
        able[lines] = True
        line, place = self._places(lines, self.n[lines])
        number = self.h[self.first[line] + place] == NUMBER_HASH
        lead = place < self.depth
        is_wild = lead & ((self.mask[line] >> np.minimum(place, self.depth) & 1) > 0)
        count_of = lambda x: np.bincount(line[x], minlength=len(self.n))
        self.n_wild, self.n_lead, self.n_number = count_of(is_wild), count_of(lead & ~is_wild & ~number), count_of(number & ~is_wild)
        self.fits = able & (10 * self.n_wild <= 3 * self.n) & (2 * (self.n - self.n_wild - self.n_number) >= self.n)
        tail = self.fits[line] & ~lead
        self.rest = line[tail], place[tail], number[tail]
        self.tail = line[tail & ~number], place[tail & ~number]

    def line_keys(self) -> np.ndarray:
        """Hashes of the lines' tokens: equal lines have equal leaves."""
        _, place = self._places(np.arange(len(self.n)), self.n)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.h * self.base[place], dtype=U64)])
        return mix(sums[self.first + self.n] - sums[self.first] + self.n.astype(U64) * LENGTH)

    def leaves(self) -> bytes:
        """Key, leaf and wildcards of each distinct line that may have a
        template, for the steps that follow, whatever order they see lines in."""
        lines = np.flatnonzero(self.fits)
        keys, at = np.unique(self.line_keys()[lines], return_index=True)
        return keys.astype("<u8").tobytes() + self.leaf[lines[at]].astype("<u8").tobytes() + self.mask[lines[at]].astype(np.uint8).tobytes()

    def put_leaves(self, raw: bytes) -> None:
        n = len(raw) // 17
        keys, leaf, mask = np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)
        own = self.line_keys()
        at = np.minimum(np.searchsorted(keys, own), max(n - 1, 0))
        lines = np.flatnonzero(keys[at] == own) if n else np.zeros(0, np.int64)
        self.leaf, self.mask = np.zeros(len(own), U64), np.zeros(len(own), np.int64)
        self.leaf[lines], self.mask[lines] = leaf[at[lines]], mask[at[lines]]
        self._settle(lines)

    def supports(self) -> np.ndarray:
        """Keys of the tokens ``tail`` in their leaves."""
        line, place = self.tail
        return np.maximum(mix(self.leaf[line] + mix(self.h[self.first[line] + place] + place.astype(U64) * LENGTH)), U64(1))

    def templates(self, support: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the lines' templates, and the line of each.  support: of the
        tokens ``tail``, 0 if it is too small."""
        line, place = (x[support > 0] for x in self.tail)
        order = np.lexsort((place, -support[support > 0], line))
        line, place = line[order], place[order]
        token = self.h[self.first[line] + place]
        # from the tail as fields (numbers stay) to more and more literal tokens
        n_lit = np.bincount(line, minlength=len(self.n))
        start = np.cumsum(n_lit) - n_lit
        steps = np.concatenate([np.zeros(1, U64), np.cumsum((token - WILD_HASH) * self.base[place], dtype=U64)])
        _, place, number = self.rest
        fields = self.base[place] * np.where(number, NUMBER_HASH, WILD_HASH)
        tails = np.concatenate([np.zeros(1, U64), np.cumsum(fields, dtype=U64)])
        ends = np.cumsum(np.where(self.fits, np.maximum(self.n - self.depth, 0), 0))
        ground = np.diff(tails[ends], prepend=U64(0))
        # k tokens of the tail as literals: the fewest that will do, to all
        n, lead = self.n, self.n_lead
        least = np.maximum(np.maximum(n - self.n_number - lead - 3 * n // 10, (n + 1) // 2 - lead), 0)
        many = np.where(self.fits, np.maximum(n_lit - least + 1, 0), 0)
        of = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(of)) - (np.cumsum(many) - many)[of] + least[of]
        key = self.leaf[of] + mix(ground[of] + steps[start[of] + k] - steps[start[of]])
        return np.maximum(mix(key + LENGTH), U64(1)), of


def _looked_up(keys: np.ndarray, side: pa.Table, kind: str) -> np.ndarray:
    """The answers to the keys that are not 0."""
    out, some = np.zeros(keys.shape, np.int64), keys > 0
    out[some] = answers(side, kind)[np.unique(keys[some], return_inverse=True)[1]]
    return out


def _grown(texts: pa.Array, depth: int, side: pa.Table, step: int):
    """The tree of a block after ``step`` steps; keys and lines of the next."""
    tree = Tree(texts, depth)
    if step == 2:
        tree.put_leaves(b"".join(p for k, p in zip(side.column("kind").to_pylist(), side.column("payload").to_pylist()) if k == LEAVES))
        return tree, *tree.templates(_looked_up(tree.supports(), side, "s"))
    keys = tree.paths()
    if step == 0:
        return tree, keys.reshape(-1), np.repeat(np.arange(len(tree.n)), keys.shape[1])
    pairs, line = tree.pairs()
    whole = np.bincount(line, _looked_up(pairs, side, "d"), len(tree.n)).astype(np.int64)
    tree.take_leaves(keys, _looked_up(keys, side, "p"), whole)
    return tree, tree.supports(), tree.tail[0]


def _send(depth: int, n_slices: int, step: int):
    """The block's keys of a step and in how many of its documents each is; of
    equal texts one counts, and none of those that count in another block."""

    def run(key, table, side):
        if not table.num_rows:
            return lists_of([])
        tree, keys, line = _grown(table.column("text").combine_chunks(), depth, side, step)
        ids = zip(table.column("_t1").to_pylist(), table.column("_t2").to_pylist())
        seen = {p for k, p in zip(side.column("kind").to_pylist(), side.column("payload").to_pylist()) if k == "skip"}
        counts = np.zeros(table.num_rows, bool)
        for d, t in enumerate(b"%d,%d" % x for x in ids):
            if t not in seen:
                seen.add(t)
                counts[d] = True
        lists = [("pst"[step], keys, line), *([("d", *tree.pairs())] if step == 0 else [])]
        rows = []
        for kind, keys, line in lists:
            # a key once for each document; lines are in their documents' order
            line, keys = line[keys > 0], keys[keys > 0]
            order = np.argsort(keys, kind="stable")
            t, d = keys[order], tree.doc[line[order]]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
            rows.append((key[0].as_py(), kind, *sorted_counts(t[new], counts[d[new]])))
        out = lists_of(rows, 64, n_slices)
        if step == 1:
            block = key[0].as_py()
            out = pa.concat_tables([out, list_table([(block, block, LEAVES, tree.leaves(), b"")])])
        return out

    return run


def _rewrite(names: list[str], depth: int):
    def run(key, table, side):
        texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        tree, keys, line = _grown(texts, depth, side, 2)
        doc, n = tree.doc, tree.n
        gone = np.bincount(line, _looked_up(keys, side, "t"), len(n)) > 0
        kept = texts.to_pylist()
        for d, lines in _by_doc(doc[gone], tree.at[gone]):
            kept[d] = "\n".join([x for k, x in enumerate(kept[d].split("\n")) if k not in lines])
        sums = [np.bincount(doc[x], n[x] if words else None, len(texts)).astype(np.int64) for words in (False, True) for x in (slice(None), gone)]
        out = table.select(names)
        for c, x in zip(MADE, (*map(pa.array, sums), pa.array([x or "" for x in kept], pa.string()))):
            out = out.append_column(c, x)
        return out

    return run


def _by_doc(doc: np.ndarray, at: np.ndarray):
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for i, j in zip(first, np.append(first[1:], len(doc))):
        yield int(doc[i]), set(at[i:j].tolist())


def drop_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 5, block_bytes: int = 6 << 20) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) plus ``n_lines``
    (with a token), ``n_dropped``, the tokens of those as ``n_words`` and
    ``n_words_dropped``, and ``kept_text``, the other lines as they were.

    Dropped is each line one of whose templates is found in ``min_docs``
    documents of different texts or more.  At most 30 % of a template's tokens
    are fields (numbers apart) and at least half are literal, so lines of three
    tokens or fewer have only their exact template, numbers apart.
    Lines without a token stay.  A null text has no lines and gives an empty
    ``kept_text``, an empty table an empty result.  doc_id may be null or
    repeated: every row is a document, and rows of equal text count as one and
    are treated alike.  Input columns named like a result, in any case, are
    replaced; other columns may have any name that doesn't begin with ``_t`` or
    ``_block``.
    """
    names = [c for c in docs.columns if c.lower() not in MADE]
    digest = {"_t1": F.xxhash64("text", F.lit(1)), "_t2": F.xxhash64("text", F.lit(2))}
    narrow = cut(docs.select("doc_id", F.length("text").cast("long").alias("n"), *(c.alias(k) for k, c in digest.items())))
    chars = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_slices, n_blocks = slices_for(max(1, chars // 6)), n_blocks_for(chars, block_bytes)
    block = F.pmod(F.xxhash64("doc_id", "_t1"), F.lit(n_blocks)).cast("int").alias("_block")
    # texts that are in several blocks count in the first of them
    where = narrow.select(block, "_t1", "_t2").distinct()
    home = where.groupBy("_t1", "_t2").agg(F.min("_block").alias("home"), F.max("_block").alias("last")).filter("home < last")
    pair = F.concat_ws(",", "_t1", "_t2").cast("binary")
    skip = where.join(home, ["_t1", "_t2"]).filter("_block > home").select(F.col("_block").alias("block"), F.lit(0).alias("slice"), F.lit("skip").alias("kind"), pair.alias("payload"))
    rows = docs.select(*names).withColumns(digest)
    rows = rows.select("*", block).repartition("_block")
    # leaves and pairs are looked up once: later steps have the leaves of the few lines that may have templates
    side = skip
    for step in range(3):
        sent = rows.groupBy("_block").cogroup(side.groupBy("block")).applyInArrow(tidy(_send(depth, n_slices, step)), LIST)
        # leaves and tokens need their counts, templates a yes or no
        often = count_answers(sent, 64, n_slices, lambda n, most=1 if step == 2 else 1 << 31: np.where(n >= min_docs, np.minimum(n, most), 0), "d", LEAVES)
        side = (skip if step == 1 else side).union(often.select(*(c.split()[0] for c in ANSWER.split(", "))))
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.StringType() if c == "kept_text" else T.LongType()) for c in MADE)])
    return rows.groupBy("_block").cogroup(side.filter("kind <> 'skip'").groupBy("block")).applyInArrow(tidy(_rewrite(names, depth)), schema)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines of recurring templates."""
    out = drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_words", "n_words_dropped", F.md5("kept_text").alias("kept_md5"))


#: The same by joins over whole lines.  {docs} has doc_id and text; p is a
#: line's path, m its wildcards, r the rank of a token in its line's chain.
LINES_SQL = r"""
doc AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS th, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
ln AS (SELECT rid, th, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM doc),
tok AS (SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR x = '<?>' THEN '<*>' ELSE x END) AS t FROM ln),
dl AS (SELECT DISTINCT t, len(t) AS n, th FROM tok WHERE len(t) > 0),
pr AS (SELECT t, n, th, unnest(range(1, n, 2)) AS i FROM dl),
twos AS (SELECT n, i, t[i] AS x, t[i + 1] AS y FROM pr GROUP BY ALL HAVING count(DISTINCT th) >= 5),
able AS (SELECT l.t, l.n FROM (SELECT DISTINCT t, n FROM dl) l LEFT JOIN (SELECT pr.t, count(DISTINCT pr.i) AS c FROM pr JOIN twos ON pr.n = twos.n AND pr.i = twos.i AND pr.t[pr.i] = x AND pr.t[pr.i + 1] = y GROUP BY pr.t) w ON l.t = w.t
  WHERE coalesce(c, 0) >= l.n // 2 - 3 * l.n // 10),
path AS (SELECT t, n, th, m, bit_count(m) AS w, list_transform(t[1:3], lambda x, i: CASE WHEN (m >> (i - 1)::INT) & 1 = 1 THEN '<?>' ELSE x END) AS p
  FROM dl, generate_series(0, 6) g(m) WHERE m < (1 << least(n, 3)::INT) - 1),
leaves AS (SELECT n, p, count(DISTINCT th) AS c FROM path GROUP BY ALL HAVING c >= 5),
own AS (SELECT t, n, arg_min(p, struct_pack(w := w, c := -c, m := m)) AS p FROM path JOIN leaves USING (n, p) GROUP BY t, n),
leaf AS (SELECT DISTINCT dl.t, dl.n, coalesce(own.p, list_transform(dl.t[1:3], lambda x: '<?>')) AS p FROM dl SEMI JOIN able USING (t) LEFT JOIN own USING (t)),
pos AS (SELECT leaf.t, leaf.n, p, th, unnest(range(4, leaf.n + 1)) AS i FROM leaf JOIN dl USING (t)),
sup AS (SELECT n, p, i, t[i] AS x, count(DISTINCT th) AS s FROM pos WHERE t[i] <> '<*>' GROUP BY ALL HAVING s >= 5),
rnk AS (SELECT t, pos.i, row_number() OVER (PARTITION BY t ORDER BY s DESC, pos.i) AS r FROM (SELECT DISTINCT t, n, p, i FROM pos) pos JOIN sup ON sup.n = pos.n AND sup.p = pos.p AND sup.i = pos.i AND sup.x = pos.t[pos.i]),
rks AS (SELECT t, map(list(i), list(r)) AS rk, count(*) AS top FROM rnk GROUP BY t),
chain AS (SELECT t, n, p, unnest(range(0, coalesce(top, 0) + 1)) AS k, rk FROM leaf LEFT JOIN rks USING (t)),
tpl AS (SELECT t, n, p || list_transform(t[4:], lambda x, i: CASE WHEN x = '<*>' OR coalesce(rk[i + 3], 1000000000) <= k THEN x ELSE '<?>' END) AS q FROM chain),
good AS (SELECT t, q FROM tpl WHERE 10 * len(list_filter(q, lambda x: x = '<?>')) <= 3 * n AND 2 * len(list_filter(q, lambda x: x NOT IN ('<?>', '<*>'))) >= n),
often AS (SELECT q FROM good JOIN dl USING (t) GROUP BY q HAVING count(DISTINCT th) >= 5),
bad AS (SELECT DISTINCT t FROM good SEMI JOIN often USING (q)),
kept AS (SELECT tok.rid, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE bad.t IS NULL) AS kept_text, count(*) FILTER (WHERE len(tok.t) > 0) AS n_lines, count(bad.t) AS n_dropped,
  coalesce(sum(len(tok.t)), 0)::BIGINT AS n_words, coalesce(sum(len(bad.t)), 0)::BIGINT AS n_words_dropped
  FROM tok LEFT JOIN bad ON tok.t = bad.t GROUP BY tok.rid),
line_dedup AS (SELECT doc.doc_id, n_lines, n_dropped, n_words, n_words_dropped, coalesce(kept_text, '') AS kept_text FROM doc JOIN kept USING (rid))
"""
OP2_SQL = "WITH " + LINES_SQL.replace("{docs}", "documents") + " SELECT doc_id, n_lines, n_dropped, n_words, n_words_dropped, md5(kept_text) AS kept_md5 FROM line_dedup"
