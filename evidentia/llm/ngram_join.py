"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set is its distinct k-word shingles.  Documents with equal sets
are one class, stood for by its smallest doc_id.  Two classes link when their
Jaccard similarity reaches the threshold; linked classes form components.

1. The number of classes that hold each shingle is estimated by a count-min
   sketch over all classes (never below the truth).  A shingle of one class
   can't be shared, so a class with too many of them has no partner and is
   done: that is the prefix filter for rare-first orders.
2. The classes left order their shared shingles by several global orders: two
   by the estimate's magnitude, rarest first, with ties by a hash of the order's
   own, and one by a hash alone.  Partners share a token in their prefixes under
   every order.  The postings of the first order give candidates; those that
   share no prefix token under the others are dropped before verification.
3. Verification intersects the sets exactly.  Within a posting list only
   pairs of different components matter: rounds of stars (one hub per list)
   link what they can, then all pairs left in the lists are looked at, dealt
   out in cells of bounded size.  Nothing is capped: components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import tidy, with_text_features
from .block_lists import LIST, answers, count_answers, list_table, lists_of, n_blocks_for
from .spark_util import collect_garbage, cut, documents, merged, salted_join, text_chars
from .substring_dedup import Sketch
from .words import Words, chunks, give_back, mix, ranges, sequence_hashes

U64 = np.uint64
ORDER_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
SIG_BITS = 16
#: Bits of a class's bitmap of shared shingles; see ``link_components``.
BITMAP = 2048


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and their distinct shingles' hashes, ascending
    within each text.  A text of 1 to k-1 words has its whole sequence."""
    parts, sizes = [], []
    for i, j, data, off in chunks(texts):
        w = Words(data, off, lower=True)
        cnt = w.counts()
        n = np.where(cnt >= k, cnt - k + 1, (cnt > 0).astype(np.int64))
        at = ranges(w.woff[:-1], n)
        h = sequence_hashes(w.hashes(), at, np.repeat(np.minimum(cnt, k), n), 0)
        doc = np.repeat(np.arange(j - i), n)
        o = np.argsort(h, kind="stable")
        small = doc.astype(np.uint16) if j - i <= 1 << 16 else doc
        o = o[np.argsort(small[o], kind="stable")]
        h, doc = h[o], doc[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        parts.append(h[new])
        sizes.append(np.bincount(doc[new], minlength=j - i))
    h = np.concatenate(parts) if parts else np.zeros(0, U64)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), h


def _keys_of(off: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """The two halves of each set's 128-bit key."""
    keys = []
    for salt in (0x9E37, 0x79B9):
        c = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(salt)), dtype=U64)])
        keys.append((c[off[1:]] - c[off[:-1]]).view(np.int64))
    return keys


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles and a 128-bit key of each row's set."""
    fields = [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("s", "n_shingles", "k1", "k2"))]

    def run(batches):
        for b in batches:
            off, h = shingle_sets(b.column("text"), k)
            keys = [pa.array(x) for x in _keys_of(off, h)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("s"), pa.array(np.diff(off), pa.int64()), *keys], names=[f.name for f in fields])
        give_back()

    return docs.select("doc_id", "s", "text").mapInArrow(run, T.StructType(fields))


def _class_sets(table: pa.Table, reps: pa.Table, k: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Of a block: the classes' names (doc_id and hash of the text), offsets
    and shingles.  Each class once, also where rows repeat."""
    want = set(zip(reps.column("rep").to_pylist(), reps.column("s").to_pylist()))
    place: dict[tuple[int, int], int] = {}
    for i, name in enumerate(zip(table.column("doc_id").to_pylist(), table.column("s").to_pylist())):
        if name in want:
            place.setdefault(name, i)
    names = sorted(place)
    off, h = shingle_sets(table.column("text").combine_chunks().take(pa.array([place[x] for x in names], pa.int64())), k)
    return names, off, h


def _send_counts(sk: Sketch, k: int):
    def run(key, table, reps):
        if not table.num_rows or not reps.num_rows:
            return list_table([])
        _, _, h = _class_sets(table, reps, k)
        cells = (np.unique(sk.cells(h, row), return_counts=True) for row in range(sk.depth))
        return lists_of([(key[0].as_py(), str(row), *c) for row, c in enumerate(cells)], sk.bits, sk.n_slices)

    return run


def _magnitude(n: np.ndarray) -> np.ndarray:
    """0 for a count of 1, 1 for 2, 2 for 3 or 4, and so on to 15."""
    return np.minimum(np.frexp(np.maximum(n - 1, 0).astype(np.float64))[1], 15)


SURVIVORS = T.StructType(
    [
        T.StructField("rep", T.LongType()),
        T.StructField("s", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("q", T.IntegerType()),
        T.StructField("toks", T.ArrayType(T.LongType())),
        T.StructField("sig2", T.ArrayType(T.IntegerType())),
        T.StructField("sig3", T.ArrayType(T.IntegerType())),
        T.StructField("bits", T.ArrayType(T.LongType())),
        T.StructField("loose", T.IntegerType()),
    ]
)


def _survivors(sk: Sketch, k: int, percent: int):
    """Classes that may have a partner: name, size, shared shingles in the first
    order, prefix length, 16-bit hashes of the other orders' prefixes, a bitmap
    of the shared shingles, and how many of them share a bit with another."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32())
    none = pa.table({f.name: pa.array([], t) for f, t in zip(SURVIVORS, kinds)})

    def run(key, table, side):
        if not table.num_rows or not side.num_rows:
            return none
        reps = side.filter(pa.array([x == "rep" for x in side.column("kind").to_pylist()]))
        names, off, h = _class_sets(table, reps, k)
        level = np.full(len(h), 15, np.int64)
        for row in range(sk.depth):
            _, inv = np.unique(sk.cells(h, row), return_inverse=True)
            level = np.minimum(level, answers(side, str(row))[inv]) if len(h) else level
        n = np.diff(off)
        c = np.concatenate([[0], np.cumsum(level > 0)])
        shared = c[off[1:]] - c[off[:-1]]
        rows = []
        for d in np.flatnonzero((shared > 0) & (100 * shared >= percent * n)):
            a, b = off[d], off[d + 1]
            x, lv = h[a:b][level[a:b] > 0], level[a:b][level[a:b] > 0]
            q = int(n[d] - (percent * n[d] + 99) // 100 + 1 - (n[d] - shared[d]))
            # two orders by rarity, whose ties differ, and one by a hash alone
            order = [np.lexsort((mix(x ^ U64(salt)), lv * (i < 2))) for i, salt in enumerate(ORDER_SALTS)]
            sig = [np.unique((x[o[:q]] >> U64(7)) & U64((1 << SIG_BITS) - 1)).astype(np.int32).tolist() for o in order[1:]]
            marks = np.zeros(BITMAP, bool)
            marks[x >> U64(64 - BITMAP.bit_length() + 1)] = True
            bits = np.packbits(marks, bitorder="little").view("<i8").tolist()
            rows.append((*names[d], int(n[d]), q, x[order[0]].view(np.int64).tolist(), *sig, bits, len(x) - int(marks.sum())))
        if not rows:
            return none
        cols = list(zip(*rows))
        return pa.table({f.name: pa.array(v, t) for f, v, t in zip(SURVIVORS, cols, (none.schema.types))})

    return run


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v): (id, label) of each end, label the smallest id of its
    component.  Minimum labels pass along edges and labels are shortcut, until
    nothing changes; the rounds grow with the logarithm of the longest path."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")).select("id", F.least("id", "label").alias("label"))
    while True:
        near = both.join(merged(labels.withColumnRenamed("id", "v")), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(merged(near), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # shortcut: the label of the label, as it was
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = cut(step.join(merged(up), "label").select("id", "old", F.least("label", "up").alias("label")))
        labels = new.select("id", "label")
        if new.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after ``links`` (u, v) of ids joined components: the
    components of the graph of labels, which is as small as the links are new."""
    a = labels.select(F.col("id").alias("u"), F.col("label").alias("lu"))
    b = labels.select(F.col("id").alias("v"), F.col("label").alias("lv"))
    between = links.join(merged(a), "u").join(merged(b), "v").filter(F.col("lu") != F.col("lv")).select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    up = connected_components(between).select(F.col("id").alias("label"), F.col("label").alias("up"))
    return cut(labels.join(merged(up), "label", "left").select("id", F.coalesce("up", "label").alias("label")))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (u, su, v, sv) of sets of different ids: (u, v) of those that link.  Size and the other
    orders' prefixes are looked at before the sets are moved."""
    small = sets.select("rep", "s", "n", "sig2", "sig3")
    a = small.select(F.col("rep").alias("u"), F.col("s").alias("su"), F.col("n").alias("nu"), F.col("sig2").alias("a2"), F.col("sig3").alias("a3"))
    b = small.select(F.col("rep").alias("v"), F.col("s").alias("sv"), F.col("n").alias("nv"), F.col("sig2").alias("b2"), F.col("sig3").alias("b3"))
    close = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")
    cand = pairs.join(merged(a), ["u", "su"]).join(merged(b), ["v", "sv"]).filter(close).select("u", "su", "v", "sv", "nu", "nv")
    toks = lambda x: sets.select(F.col("rep").alias(x), F.col("s").alias(f"s{x}"), F.col("toks").alias(f"t{x}"))
    full = cand.join(merged(toks("v")), ["v", "sv"]).join(merged(toks("u")), ["u", "su"])
    both = F.size(F.array_intersect("tu", "tv"))
    return full.withColumn("x", both).filter(F.col("x") * 100 >= (F.col("nu") + F.col("nv") - F.col("x")) * percent).select("u", "v")


def link_components(sets: DataFrame, percent: int, star_rounds: int = 3, part: int = 256, pairs_per_task: int = 2_000_000) -> DataFrame:
    """sets: the surviving classes.  (id, label) of each id among them; the
    sets of one id (rep, s) are one node.

    A pair of a posting list is a candidate only if its sizes, the token's two
    places and the bitmaps leave the threshold possible: a bit of one side only
    is a shingle that isn't shared, so the overlap is at most the size less
    those bits.  None of these bounds loses a link.
    """
    labels = cut(sets.select(F.col("rep").alias("id"), F.col("rep").alias("label")).distinct())
    post = sets.select("rep", "s", "n", F.size("toks").alias("m"), F.posexplode(F.slice("toks", F.lit(1), F.col("q"))).alias("at", "token"))
    # lists of equal members are one; lists of one member say nothing
    lists = post.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("rep", "s").cast("decimal(38,0)")).alias("h"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    keep = cut(lists.filter("c > 1").groupBy("c", "h", "lo", "hi").agg(F.min("token").alias("token")).select("token", "c"))
    post = cut(salted_join(post, keep, ["token"], "c", ["rep", "s"]).drop("c"))
    # what a shared token at its two places leaves possible: sizes, and the overlap before, at and after it
    most = F.least("au", "av") + 1 + F.least(F.col("mu") - F.col("au"), F.col("mv") - F.col("av")) - 1
    possible = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & (most * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent)
    member = ("rep", "s", "label", "n", "m", "at")
    side = lambda x, of="": [F.col(of + c).alias({"rep": x, "at": f"a{x}"}.get(c, c[0] + x)) for c in member]
    links = None
    for r in range(star_rounds + 1):
        marked = post.join(merged(labels.withColumnRenamed("id", "rep")), "rep")
        # the hub of a list: its member with the smallest hash of this round (the smallest id at first)
        key = F.struct("rep", "s") if r == 0 else F.struct(F.xxhash64("rep", F.lit(r)), "rep", "s")
        per = marked.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct(*member), key).alias("hub"))
        mixed = cut(per.filter("lo < hi").select("token", "c", "hub"))
        total, top, work = mixed.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0)), F.coalesce(F.sum(F.col("c").cast("double") * F.col("c")), F.lit(0.0))).first()
        if not total:
            break
        if r < star_rounds:
            pairs = salted_join(marked, mixed, ["token"], "c", ["rep", "s"], sums=(total, top)).select(*side("u", "hub."), *side("v")).filter((F.col("lu") != F.col("lv")) & possible)
        else:
            pairs = _list_pairs(salted_join(marked, mixed.drop("hub"), ["token"], "c", ["rep", "s"], sums=(total, top)), work, sets, percent, part, pairs_per_task, side, possible)
        found = cut(_verify(pairs.select("u", "su", "v", "sv").distinct(), sets, percent))
        links = found if links is None else links.unionByName(found)
        if r < star_rounds:  # labels need not be final here: equal ones mean linked, which is all that is used
            both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
            near = both.join(merged(labels.withColumnRenamed("id", "v")), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
            labels = cut(labels.join(merged(near), "id", "left").select("id", F.least("label", "near").alias("label")))
        collect_garbage(sets.sparkSession)
    ids = labels.select("id", F.col("id").alias("label"))
    if links is None:
        return ids
    of = connected_components(links).select("id", F.col("label").alias("of"))
    return cut(ids.join(merged(of), "id", "left").select("id", F.coalesce("of", "label").alias("label")))


def _list_pairs(members: DataFrame, work: float, sets: DataFrame, percent: int, part: int, pairs_per_task: int, side, possible) -> DataFrame:
    """All possible pairs of different components within the lists.  The
    members of a list are dealt to parts of about ``part``; a pair of parts is a
    cell, and cells are dealt to as many tasks as there are pairs to look at
    (``work``, the lists' squared lengths, is twice that)."""
    n_tasks = int(min(100_000, max(sets.sparkSession.sparkContext.defaultParallelism, work / 2 / pairs_per_task)))
    parts = F.ceil(F.col("c") / F.lit(part)).cast("int")
    wide = members.join(merged(sets.select("rep", "s", "bits", "loose")), ["rep", "s"]).withColumns({"parts": parts, "g": F.pmod(F.xxhash64("rep", "s"), parts).cast("int")})
    more = lambda x: [F.col("bits").alias(f"b{x}"), F.col("loose").alias(f"o{x}")]
    rows = wide.select("token", *side("u"), *more("u"), F.col("g").alias("i"), F.explode(F.sequence("g", F.col("parts") - 1)).alias("j"))
    cols = wide.select("token", *side("v"), *more("v"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("i"), F.col("g").alias("j"))
    cell = ["token", "i", "j"]
    # shingles of one side whose bit the other lacks aren't shared: at most the common bits are, and those that share a bit
    common = sum((F.bit_count(F.col("bu")[i].bitwiseAND(F.col("bv")[i])) for i in range(BITMAP // 64)), F.lit(0))
    close = (common + F.least("ou", "ov")) * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent
    pairs = rows.repartition(n_tasks, *cell).join(merged(cols.repartition(n_tasks, *cell)), cell)
    once = (F.col("i") < F.col("j")) | (F.struct("u", "su") < F.struct("v", "sv"))
    return pairs.filter(once & (F.col("lu") != F.col("lv")) & possible & close)


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = 6 << 20) -> DataFrame:
    """docs (doc_id integer, text, ...): all rows and columns with
    ``n_shingles`` and ``component_id``, the smallest doc_id that links reach.

    Words are lower-cased in ASCII.  A text with fewer than ``k`` words has its
    whole sequence as one shingle; null and empty texts have none, link with
    nothing and are their own component.  A row with a null doc_id has a null
    component and links with nothing.  Rows with equal doc_id are one document
    with the links of all its texts.  Input columns of those names are
    replaced; other columns may have any name that doesn't begin with ``_``.
    """
    names = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    rows = docs.select(*names).withColumn("_id", F.col("doc_id").cast("long"))
    plain = rows.select(F.col("_id").alias("doc_id"), "text", F.xxhash64("text").alias("s"))
    sets = cut(set_keys(plain, k))
    real = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["n_shingles", "k1", "k2"]
    classes = cut(real.groupBy(*key).agg(F.min(F.struct("doc_id", "s")).alias("r"), F.count(F.lit(1)).alias("c")).select(*key, "c", F.col("r.doc_id").alias("rep"), "r.s"))
    chars = text_chars(docs)
    sk = Sketch(max(1, chars // 5), 1, 8)
    # rows of one id are apart unless their texts are equal
    block = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_blocks_for(chars, block_bytes))).cast("int")
    blocks = plain.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("_block", block("doc_id", "s")).repartition("_block")
    reps = classes.select("rep", "s", block("rep", "s").alias("block"))
    sent = blocks.groupBy("_block").cogroup(reps.groupBy("block")).applyInArrow(tidy(_send_counts(sk, k)), LIST)
    counted = count_answers(sent, sk.bits, sk.n_slices, _magnitude)
    null = F.lit(None)
    side = counted.withColumns({"rep": null.cast("long"), "s": null.cast("long")}).unionByName(
        reps.select("block", F.lit(0).alias("slice"), F.lit("rep").alias("kind"), null.cast("binary").alias("payload"), "rep", "s")
    )
    left = cut(blocks.groupBy("_block").cogroup(side.groupBy("block")).applyInArrow(tidy(_survivors(sk, k, percent)), SURVIVORS))
    labels = link_components(left, percent)
    # rows of equal doc_id and different texts are one document: their classes link
    varied = cut(real.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).filter("a != b").select("doc_id"))
    if not varied.isEmpty():
        of_id = cut(real.join(varied, "doc_id").join(classes, key).select("doc_id", "rep").distinct())
        ties = of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("u")), "doc_id").filter("rep > u").select("u", F.col("rep").alias("v"))
        ends = of_id.select(F.col("rep").alias("id")).distinct().join(labels, "id", "left_anti")
        labels = relabel(cut(labels.unionByName(ends.select("id", F.col("id").alias("label")))), ties)
    # several classes of one doc_id share it as their rep
    of_class = cut(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(*key, "c", F.coalesce("label", "rep").alias("component_id")))
    linked = salted_join(real, of_class, key, "c", ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    alone = sets.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    per_row = linked.unionByName(alone)
    if names == ["doc_id", "text"] or set(names) == {"doc_id"}:
        return per_row
    known = per_row.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    named = rows.filter("_id IS NOT NULL").join(known, "_id").drop("_id")
    size = lambda texts: {"n_shingles": pa.array(np.diff(shingle_sets(texts, k)[0]), pa.int64())}
    unnamed = with_text_features(rows.filter("_id IS NULL").drop("_id"), size, [T.StructField("n_shingles", T.LongType())])
    return named.unionByName(unnamed.withColumn("component_id", F.lit(None).cast("long")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the
    document with the smallest doc_id stays (all its rows); rows without an id
    stay."""
    ids = ngram_components(docs.select("doc_id", "text"), k, percent)
    gone = ids.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_components(documents(spark, sf_dir).select("doc_id", "text"))


#: The same by counting shared shingles of all pairs that share one.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 4))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * x >= 80 * (a.n + b.n - x)),
r AS (SELECT doc_id AS s, doc_id AS r FROM w UNION SELECT r.s, l.v FROM r JOIN l ON l.u = r.r)
SELECT s AS doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id FROM r LEFT JOIN n ON n.doc_id = s GROUP BY s, n"""
