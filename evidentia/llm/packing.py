"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces (at most ``capacity`` tokens each) are dealt by hash into blocks of a
bounded number of pieces; a block is a bin-packing problem of its own.  Each
block is evolved on several islands.  A chromosome is a grouping: a list of
bins.  Crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold a duplicate and best-fits the displaced pieces;
mutation empties some of the least filled bins.  After each epoch the islands'
elites migrate along a ring of the block's islands (a shuffle of small
arrays).  The best grouping of a block wins; the pieces of its badly filled
bins go to the next level, where blocks of such pieces are packed again.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_util import cut, documents
from .words import buffers, chunks, give_back

END_ID = 0
#: Bytes of texts whose new words are learned together: few enough to stay in a core's cache.
LEARN_BYTES = 1 << 16

# ---------------------------------------------------------------- tokens


#: Lower-case words that composing leaves as they are.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printing
    ones for themselves, the others for those from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class WordTokens:
    """Token ids of texts through a cache of words.

    The vocabulary's pre-tokenizer drops white space and parts letters from
    punctuation, and its normalizer lower-cases and composes, neither across an
    ASCII separator, so a text's ids are the ids of its words, one after the
    other, and a word may be cut between a letter or digit and its last marks.
    Words of Latin letters alone are one pre-token, which goes to the model as
    it is; other words seen for the first time are encoded together, between
    marks of their own.  Texts that hold a special token's string are encoded
    whole.

    The cache lives as long as the worker process.  It has two generations of
    about ``most`` words; the older one goes when the younger is full.
    """

    BETWEEN = b"|"
    #: ASCII marks but the apostrophe, which begins contractions.
    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most, self.young, self.old = most, {}, {}
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.between_id = self._encode(self.BETWEEN)[0]

    def _encode(self, raw: bytes) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: set[bytes]) -> None:
        """Ids of words that aren't in the younger generation."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, fresh = self.young, self.old, []
        for w in words:
            got = old.get(w)
            if got is None:
                fresh.append(w)
            else:
                young[w] = got
        # after a letter or digit a word's last marks are pre-tokens of their own
        parts, need = [], set()
        for w in fresh:
            core = w.rstrip(self.MARKS)
            tail = w[len(core) :]
            if tail and core and (core[-1:].isalnum() or core[-1] >= 128 and core.decode()[-1].lower()[-1].isalpha()):
                parts.append((w, core, tail))
                need.add(core)
                need.add(tail)
            else:
                need.add(w)
        get = lambda x: young.get(x) or old.get(x)
        plain, tokenize, id_bytes = [], self.tok.model.tokenize, self.id_bytes
        for w in need:
            if get(w) is None:
                low = w.decode().lower()
                if LETTERS.fullmatch(low):
                    mapped = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_CHARS)
                    young[w] = b"".join([id_bytes[t.id] for t in tokenize(mapped)])
                else:
                    plain.append(w)
        whole = [w for w in plain if self.BETWEEN in w]
        young.update((w, self._encode(w).tobytes()) for w in whole)
        if whole:
            plain = [w for w in plain if self.BETWEEN not in w]
        between = b" " + self.BETWEEN + b" "
        for k in range(0, len(plain), 4000):
            part = plain[k : k + 4000]
            ids = self._encode(between.join(part))
            at = (np.flatnonzero(ids == self.between_id) * 4).tolist()
            raw = ids.tobytes()
            young.update(zip(part, [raw[i:j] for i, j in zip([0, *(x + 4 for x in at)], [*at, len(raw)])]))
        young.update([(w, get(core) + get(tail)) for w, core, tail in parts])

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; words that
        are new to the texts are learned together."""
        split: list[list[bytes] | None] = []
        for t in texts:
            odd = b"<|" in t and any(s in t for s in self.special)
            split.append(None if odd else t.lower().split())
        words: set[bytes] = set()
        words.update(*(x for x in split if x is not None))
        self._learn(words.difference(self.young))
        try:
            get = self.young.__getitem__
            return [self._encode(t).tobytes() if x is None else b"".join(map(get, x)) for t, x in zip(texts, split)]
        except KeyError:  # a generation ended between: all are learned into the new one
            self._learn(words.difference(self.young))
            get = self.young.__getitem__
            return [self._encode(t).tobytes() if x is None else b"".join(map(get, x)) for t, x in zip(texts, split)]

    def ids(self, text: bytes) -> bytes:
        return self.ids_of([text])[0]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if
    asked, ids.

    A text's ids are followed by id 0; a null or empty text is that id alone.
    Only documents longer than ``capacity`` are cut; the last piece may be
    shorter.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        words = word_tokens(path or tokenizer_path())
        for batch in batches:
            rows, piece, start, length, crc, blobs = [], [], [], [], [], []
            data, off = buffers(batch.column("text"))
            raw, found = data.tobytes(), []
            for i, j, _, _ in chunks(batch.column("text"), LEARN_BYTES):
                found += words.ids_of([raw[off[r] : off[r + 1]] for r in range(i, j)])
            for r, ids in enumerate(found):
                ids += end
                n = len(ids) // 4
                for p, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * min(n, s + capacity)]
                    rows.append(r), piece.append(p), start.append(s), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        blobs.append(part)
            at = pa.array(rows, pa.int64())
            cols = [batch.column("doc_id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(blobs, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


# ---------------------------------------------------------------- the genetic algorithm


class Grouping:
    """Bins of item numbers; items are places in the block's length array."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins = bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.cost = sum((f / capacity) ** 2 for f in self.fill)

    def key(self) -> tuple[int, float]:
        """Fewer bins first; among equals those that leave room in one place."""
        return (len(self.bins), -self.cost)


def best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing of ``items`` into (and beyond) ``bins``."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -lengths[i]):
        need = lengths[i]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > need:
            insort(room, (left - need, k))
    return bins


def crossover(a: Grouping, b: Grouping, lengths: list[int], capacity: int, rng: np.random.Generator) -> Grouping:
    """Well-filled bins of ``b`` whole, then the bins of ``a`` without an item
    of those; displaced items are best-fitted."""
    order = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    good = order[: max(1, len(order) // 2)]
    chosen = [k for k, u in zip(good, rng.random(len(good))) if u < 0.5] or good[:1]
    taken = {i for k in chosen for i in b.bins[k]}
    bins, loose = [list(b.bins[k]) for k in chosen], []
    for bin_ in a.bins:
        if taken.isdisjoint(bin_):
            bins.append(list(bin_))
        else:
            loose += [i for i in bin_ if i not in taken]
    return Grouping(best_fit(bins, loose, lengths, capacity), lengths, capacity)


def mutate(g: Grouping, lengths: list[int], capacity: int, rng: np.random.Generator) -> Grouping:
    """Empty the least filled bin and a few others, best-fit their items."""
    n = len(g.bins)
    drop = {min(range(n), key=g.fill.__getitem__), *map(int, rng.integers(0, n, max(1, n // 50)))}
    loose = [i for k in drop for i in g.bins[k]]
    rng.shuffle(loose)
    bins = [list(b) for k, b in enumerate(g.bins) if k not in drop]
    return Grouping(best_fit(bins, loose, lengths, capacity), lengths, capacity)


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], rng: np.random.Generator, population: int = 6, children: int = 16) -> list[Grouping]:
    """One epoch of an island; stops at the lower bound of bins."""
    bound = -(-sum(lengths) // capacity)
    items = list(range(len(lengths)))
    pop = [Grouping(s, lengths, capacity) for s in seeds]
    if not pop:
        pop = [Grouping(best_fit([], items, lengths, capacity), lengths, capacity)]
    while len(pop) < population and min(len(g.bins) for g in pop) > bound:
        first = rng.permutation(len(items))[: len(items) // 2]
        bins: list[list[int]] = []
        for i in map(int, first):  # first fit of a random half into the last bin, then best fit
            if bins and sum(lengths[x] for x in bins[-1]) + lengths[i] <= capacity:
                bins[-1].append(i)
            else:
                bins.append([i])
        rest = set(items).difference(map(int, first))
        pop.append(Grouping(best_fit(bins, sorted(rest), lengths, capacity), lengths, capacity))
    for _ in range(children):
        if min(len(g.bins) for g in pop) <= bound:
            break
        x, y = (min(rng.choice(len(pop), 2), key=lambda k: pop[k].key()) for _ in range(2))
        child = crossover(pop[x], pop[y], lengths, capacity, rng) if x != y else mutate(pop[x], lengths, capacity, rng)
        if rng.random() < 0.3:
            child = mutate(child, lengths, capacity, rng)
        worst = max(range(len(pop)), key=lambda k: pop[k].key())
        if child.key() < pop[worst].key():
            pop[worst] = child
    return sorted(pop, key=Grouping.key)


def _pack_bins(g: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(g):
        out[b] = k
    return out.tobytes()


def _unpack_bins(x: bytes) -> list[list[int]]:
    of = np.frombuffer(x, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return bins


#: Islands that a task evolves, about, and tasks at most.
ISLANDS_PER_TASK, MOST_TASKS = 8, 20_000
ISLAND = "block long, island int, home int, bins int, cost double, lengths binary, genes binary"


def _epoch(capacity: int, epoch: int, elites: int):
    def run(key, t):
        block, island = key[0].as_py(), key[1].as_py()
        lengths = np.frombuffer(t.column("lengths")[0].as_py(), "<i4").tolist()
        seeds = [_unpack_bins(g) for g in sorted({x.as_py() for x in t.column("genes") if x.as_py() is not None})]
        rng = np.random.default_rng([abs(block) + 1, island, epoch])
        pop = evolve(lengths, capacity, seeds, rng)[:elites]
        n = len(pop)
        return pa.table(
            {
                "block": pa.array([block] * n, pa.int64()),
                "island": pa.array([island] * n, pa.int32()),
                "home": pa.array([island] * n, pa.int32()),
                "bins": pa.array([len(g.bins) for g in pop], pa.int32()),
                "cost": pa.array([g.cost for g in pop], pa.float64()),
                "lengths": pa.array([t.column("lengths")[0].as_py()] * n, pa.binary()),
                "genes": pa.array([_pack_bins(g.bins, len(lengths)) for g in pop], pa.binary()),
            }
        )

    return run


def pack_blocks(blocks: DataFrame, n_blocks: int, capacity: int, islands: int, epochs: int, elites: int) -> DataFrame:
    """blocks: (block, lengths).  One row per block with its best genes.

    An island is a few kB and 20 to 100 ms of work, so islands are dealt to
    tasks by number, not by bytes; beyond ``MOST_TASKS`` a task has more of
    them, one after the other."""
    n_tasks = min(MOST_TASKS, -(-n_blocks * islands // ISLANDS_PER_TASK))
    start = blocks.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "lengths", F.lit(None).cast("binary").alias("genes"))
    state = start.repartition(n_tasks, "block", "island").groupBy("block", "island").applyInArrow(_epoch(capacity, 0, elites), ISLAND)
    for e in range(1, epochs):
        # an elite stays on its island, and the best one goes to the next as well
        moved = state.withColumn("island", F.explode(F.array("home", ((F.col("home") + 1) % islands).cast("int"))))
        state = moved.repartition(n_tasks, "block", "island").groupBy("block", "island").applyInArrow(_epoch(capacity, e, elites), ISLAND)
    best = F.min_by(F.struct("lengths", "genes"), F.struct("bins", -F.col("cost"), "home", "genes"))
    return state.groupBy("block").agg(best.alias("g")).select("block", "g.*")


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    block_rows: int = 1024,
    islands: int = 2,
    epochs: int = 2,
    elites: int = 2,
    levels: int = 3,
    well_filled: float = 0.99,
) -> DataFrame:
    """All rows and columns of ``pieces`` (length, ...) with ``sequence_id``
    and ``offset`` (gapless from 0 in each sequence).

    Pieces of the full capacity (or more) are sequences of their own.  The
    others are dealt evenly to blocks by a hash of their place in the
    materialised input, so equal rows spread as all others do and are packed
    one by one.  Pieces of bins filled below ``well_filled`` go to the next
    level, but for the last.  An empty table gives an empty result; a null or
    negative length counts as 0; columns must be sortable (no maps).  Columns
    named like a result are replaced; others may have any name that doesn't
    begin with ``_``.
    """
    pieces = pieces.drop("sequence_id", "offset")
    length = F.greatest(F.coalesce(F.col("length"), F.lit(0)), F.lit(0)).cast("long")
    rows = cut(pieces.withColumns({"_len": length, "_uid": F.monotonically_increasing_id()}))
    whole = rows.filter(F.col("_len") >= capacity)
    out = whole.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    todo = rows.filter(F.col("_len") < capacity)
    spread = 64 * block_rows  # bins of a block, at most its pieces
    for level in range(levels):
        n = todo.count()
        if not n:
            break
        n_blocks = -(-n // block_rows)
        dealt = todo.withColumn("_block", F.pmod(F.xxhash64("_uid", F.lit(level)), F.lit(n_blocks)))
        items = F.collect_list(F.struct("_len", "_uid", F.struct(*rows.columns).alias("row")))
        blocks = cut(dealt.groupBy("_block").agg(F.sort_array(items, asc=False).alias("items")))
        packed = cut(_place(blocks, n_blocks, rows.schema, capacity, islands, epochs, elites))
        number = F.col("_block") * spread + F.col("_bin") + F.lit((level + 1) << 58)
        good = F.col("_fill") >= well_filled * capacity
        last = level == levels - 1 or n_blocks == 1
        fixed = packed if last else packed.filter(good)
        out = out.unionByName(fixed.withColumn("sequence_id", number).select(*out.columns))
        if last:
            break
        todo = packed.filter(~good).select(*rows.columns)
    return out.drop("_len", "_uid")


def _place(blocks: DataFrame, n_blocks: int, row_schema: T.StructType, capacity: int, islands: int, epochs: int, elites: int) -> DataFrame:
    """blocks: (_block, items, longest first).  The items' rows, each with
    _block, _bin, _fill (of its bin) and offset."""
    lens = F.transform("items", lambda x: x["_len"])
    best = pack_blocks(blocks.select(F.col("_block").alias("block"), _int_bytes(lens).alias("lengths")), n_blocks, capacity, islands, epochs, elites)
    joined = blocks.join(best.select(F.col("block").alias("_block"), "genes", "lengths"), "_block").select("_block", "genes", "lengths", F.col("items.row").alias("rows"))
    extra = ("_block", "_bin", "_fill", "offset")
    names = [f.name for f in row_schema]
    schema = T.StructType([*row_schema, *(T.StructField(c, T.LongType()) for c in extra)])

    def place(batches):
        for b in batches:
            for k in range(b.num_rows):
                of = np.frombuffer(b.column("genes")[k].as_py(), "<i4").astype(np.int64)
                ln = np.frombuffer(b.column("lengths")[k].as_py(), "<i4").astype(np.int64)
                order = np.argsort(of, kind="stable")
                upto = np.cumsum(ln[order]) - ln[order]
                first = np.concatenate([[True], of[order][1:] != of[order][:-1]])
                offset = np.empty(len(of), np.int64)
                offset[order] = upto - np.maximum.accumulate(np.where(first, upto, 0))
                fill = np.bincount(of, ln).astype(np.int64)[of]
                block = np.full(len(of), b.column("_block")[k].as_py(), np.int64)
                cols = b.column("rows")[k].values.flatten()
                yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, (block, of, fill, offset))], names=[*names, *extra])

    return joined.mapInArrow(place, schema)


def _int_bytes(lens):
    """An int array as little-endian 32-bit bytes (lengths are below 2**31)."""
    hexes = F.transform(lens, lambda x: F.concat(*(F.lpad(F.hex(F.shiftright(x, s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24))))
    return F.unhex(F.array_join(hexes, ""))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Tokens of ``docs`` (doc_id, text), cut and packed: one row per piece."""
    out = pack(token_pieces(docs, capacity, path), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
