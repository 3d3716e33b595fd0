"""Full-text search (BM25), exact vector search, and reciprocal-rank fusion.

Every operator takes many queries at once and an optional group (case) column;
statistics are per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from evidentia.functions.text import dense_excerpt, fold, tokens

K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60
MAX_TERMS = 10_000
#: Hits of about 50 bytes that are broadcast to the texts.
MAX_HITS_SENT = 200_000


# ---------------------------------------------------------------- index


def postings(units: DataFrame, id_col: str = "doc_id", text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """(group..., id, term, tf, dl): a row per distinct term of each unit.

    The terms of a unit are counted before they are exploded, so the shuffle
    of a later aggregate by term carries one row per distinct term.
    """
    keep = [*group, id_col]
    toks = units.select(*keep, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t"))
    term = toks.select(*keep, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return term.groupBy(*keep, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def sorted_postings(batch: pa.RecordBatch, group: Sequence[str], id_col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(group..., id, dl, term, tf) of a batch of units with their tokens ``_t``:
    the distinct terms of each, an empty term once among them.  Runs of units of
    about ``most`` tokens are each in the order of group, term and unit."""
    sizes = _sizes(batch.column("_t"))
    ends = np.cumsum(sizes + 1)
    i, n_rows = 0, batch.num_rows
    while i < n_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        part, size, n = batch.slice(i, j - i), sizes[i:j], j - i
        flat = pa.compute.dictionary_encode(part.column("_t").flatten())
        names = pa.concat_arrays([pa.array([""], flat.dictionary.type), flat.dictionary])
        by_name, place = _order(names)
        case = np.zeros(n, np.int64)
        for g in group:
            codes = pa.compute.dictionary_encode(part.column(g), null_encoding="encode")
            case = case * len(codes.dictionary) + _order(codes.dictionary)[1][np.asarray(codes.indices)]
            case = np.unique(case, return_inverse=True)[1]
        unit = np.concatenate([np.arange(n), np.repeat(np.arange(n), size)])
        term = place[np.concatenate([np.zeros(n, np.int64), np.asarray(flat.indices, np.int64) + 1])]
        key, tf = np.unique((case[unit] * len(names) + term) * n + unit, return_counts=True)
        unit, term = key % n, by_name[key // n % len(names)]
        at = pa.array(unit)
        made = [pa.array(size[unit]), names.take(pa.array(term)), pa.array(tf, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in (*group, id_col)), *made], names=[*group, id_col, "dl", "term", "tf"])
        i = j


def _order(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of distinct values in their order, and the place of each in it."""
    by_value = np.asarray(pa.compute.sort_indices(values), np.int64)
    place = np.empty(len(values), np.int64)
    place[by_value] = np.arange(len(values))
    return by_value, place


def index_rows(units: DataFrame, id_col: str = "doc_id", text: str = "text", group: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """Postings to be stored: (group..., id, dl, term, tf), with a row of an
    empty term for each unit, which carries its length into the statistics; with
    ``totals`` also, for each group of a task, a row without a unit and a term:
    its units (tf) and tokens (dl).

    A unit is one row, so its terms are counted where it lies, without an
    exchange of all postings.  They leave in long sorted runs, which the sort
    of a stored table merges instead of sorting them anew.
    """
    keep = [*group, id_col]
    schema = T.StructType([*(T.StructField(c, units.schema[c].dataType) for c in keep), T.StructField("dl", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[int, int]] = {}
        kinds = None
        for b in batches:
            for made in sorted_postings(b, group, id_col):
                if totals:
                    kinds, of = made.schema, pa.table(made).filter(pa.compute.equal(made.column("term"), ""))
                    for *g, n, dl in zip(*(x.to_pylist() for x in of.group_by(list(group)).aggregate([("dl", "count"), ("dl", "sum")]).select([*group, "dl_count", "dl_sum"]).columns)):
                        had = sums.get(tuple(g), (0, 0))
                        sums[tuple(g)] = had[0] + n, had[1] + dl
                yield made
        if sums:
            rows = [dict(zip(group, g)) | {"tf": n, "dl": dl} for g, (n, dl) in sums.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return units.select(*keep, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t")).mapInArrow(run, schema)


def index_stats(index: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., n_docs, avg_dl) of a stored index: the sum of what its writes
    added, a few rows of each case."""
    s = index.filter(F.col("term").isNull()).groupBy(*group).agg(F.sum("tf").alias("n_docs"), F.sum("dl").alias("_dl")).filter("n_docs > 0")
    return s.select(*group, "n_docs", (F.col("_dl") / F.col("n_docs")).alias("avg_dl"))


def corpus_stats(units: DataFrame, text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """(group..., n_docs, avg_dl) over all units, empty ones included."""
    dl = F.coalesce(F.size(tokens(F.coalesce(F.col(text), F.lit("")))), F.lit(0))
    return units.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(dl).alias("avg_dl"))


def term_stats(units: DataFrame, id_col: str = "doc_id", text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """(group..., term, df, cf): units that hold the term, and occurrences."""
    return postings(units, id_col, text, group).groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# ---------------------------------------------------------------- BM25


def idf(n: Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5)), 1e-6 where that isn't positive."""
    x = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(x > 0, x).otherwise(F.lit(LEAST_IDF))


def bm25(
    queries: DataFrame,
    units: DataFrame | None,
    k: int | Column = 10,
    id_col: str = "doc_id",
    text: str = "text",
    group: Sequence[str] = (),
    index: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """queries (query_id, query, group...) against units: (query_id, id, mode,
    score, rank), at most ``k`` per query.

    All folded terms of the query must occur; if no unit has them all and the
    query has two tokens or more, any term will do (mode ``or``).  Repeated
    query tokens add up.  Scores are negative, the smallest first, ties by id.
    A query without a letter or digit gives nothing.  ``index`` and ``stats``
    are prebuilt postings and corpus statistics.

    Without an index the texts are scanned once: of each unit only its length
    and the query's terms leave the scan, and counts, document frequencies and
    corpus statistics come from the same exchange.  The distinct terms of the
    query set go into the plan up to ``MAX_TERMS``; a larger query set is
    joined to the postings.
    """
    g = list(group)
    q = queries.select(*g, "query_id", F.posexplode(tokens("query")).alias("_p", "term"))
    qt = q.groupBy(*g, "query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    # the query's own size goes with its terms: hits don't have to be gathered by query for it
    size = W.partitionBy(*g, "query_id")
    qt = qt.withColumns({"n_terms": F.count(F.lit(1)).over(size), "n_tokens": F.sum("qf").over(size)})
    terms = [r["term"] for r in qt.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    if index is not None:
        # of a stored index only the query's terms are read
        index = index.filter(F.col("term").isin(terms)) if len(terms) <= MAX_TERMS else index.filter(F.col("term") != "")
    elif len(terms) <= MAX_TERMS:
        index, made = _term_counts(units, terms, id_col, text, g)
        stats = stats if stats is not None else made
    else:
        index = postings(units, id_col, text, g).join(qt.select(*g, "term").distinct(), [*g, "term"], "left_semi")
    stats = stats if stats is not None else corpus_stats(units, text, g)
    # tf and dl are carried so that this aggregate reads the same exchange as the hits
    df = index.groupBy(*g, "term").agg(F.struct(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("dl")).alias("_t"))
    df = df.filter(F.col("_t.cf") + F.col("_t.dl") > 0).select(*g, "term", F.col("_t.df").alias("df"))
    scored = index.join(qt, [*g, "term"]).join(df, [*g, "term"])
    scored = _with_stats(scored, stats, g)
    part = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    per = scored.groupBy(*g, "query_id", id_col).agg((-F.sum(F.col("qf") * part)).alias("score"), F.count(F.lit(1)).alias("matched"), F.max("n_terms").alias("n_terms"), F.max("n_tokens").alias("n_tokens"))
    return _best(per.withColumn("score", F.round("score", 9)), k, id_col, g)


def _best(hits: DataFrame, k: int | Column, id_col: str, g: list[str]) -> DataFrame:
    """The ``k`` best of each query's hits (matched, n_terms, n_tokens, score).

    Hits with all terms and the others are ranked apart, so that each task sends
    ``k`` rows of either on; of those few it is seen whether any has all terms,
    and the others are dropped where one has.
    """
    hits = hits.withColumn("_all", F.col("matched") == F.col("n_terms")).filter(F.col("_all") | (F.col("n_tokens") >= 2))
    apart = hits.withColumn("rank", F.row_number().over(W.partitionBy(*g, "query_id", "_all").orderBy("score", id_col))).filter(F.col("rank") <= k)
    any_all = F.max("_all").over(W.partitionBy(*g, "query_id"))  # 2 k rows at most
    best = apart.withColumn("_and", any_all).filter(F.col("_all") == F.col("_and"))
    return best.select(*g, "query_id", id_col, F.when(F.col("_all"), "and").otherwise("or").alias("mode"), "score", "rank")


def _term_counts(units: DataFrame, terms: list[str], id_col: str, text: str, g: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings of ``terms`` alone, and the corpus statistics: each unit has a
    row with an empty term for the latter."""
    toks = units.select(*g, id_col, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t"))
    wanted = F.filter("_t", lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")
    rows = toks.select(*g, id_col, F.size("_t").alias("dl"), F.explode(F.concat(wanted, F.array(F.lit("")))).alias("_x"))
    counts = rows.select(*g, id_col, "dl", F.coalesce("_x", F.lit("")).alias("term")).groupBy(*g, id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    none = F.col("term") == ""
    # tf is carried so that this aggregate reads the same exchange as the hits, and texts are read once
    stats = counts.groupBy(*g).agg(F.struct(F.count_if(none).alias("n_docs"), F.avg(F.when(none, F.col("dl"))).alias("avg_dl"), F.sum("tf").alias("cf")).alias("_s"))
    return counts, stats.filter(F.col("_s.cf") > 0).select(*g, F.col("_s.n_docs").alias("n_docs"), F.col("_s.avg_dl").alias("avg_dl"))


def _with_stats(df: DataFrame, stats: DataFrame, g: list[str]) -> DataFrame:
    """Statistics beside every row; without groups they are one row."""
    if g:
        return df.join(stats, g)
    one = stats.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


#: A token and what stands between it and the next.
TOKEN_RE, BEFORE_RE = r"([\p{L}\p{N}]+)([^\p{L}\p{N}]*)", r"^[^\p{L}\p{N}]*"


def snippets(hits: DataFrame, queries: DataFrame, units: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 24, k: int | None = None) -> DataFrame:
    """``hits`` (query_id, id, ...) with ``snippet``: the window of 24 tokens
    that holds the most distinct query terms, those marked «so», and … where
    text is left out; without a hit the first window, without a token the first
    200 characters.  Only texts of hits are joined; with ``k`` hits of a query
    at most the hits are sent to the texts, if they are few.

    The windows that begin at a hit are compared by what they share with the
    query, an intersection of ``window`` tokens each.
    """
    asked = hits.join(queries.select("query_id", F.array_distinct(tokens("query")).alias("_want")), "query_id")
    if k is not None and queries.count() * k <= MAX_HITS_SENT:
        asked = F.broadcast(asked)
    s = units.select(id_col, F.col(text).alias("_text")).join(asked, id_col)
    part = lambda i: F.regexp_extract_all("_text", F.lit(TOKEN_RE), F.lit(i))
    s = s.withColumns({"_t": part(1), "_gap": part(2)})
    s = s.withColumns({"_f": F.split(fold(F.array_join("_t", " ")), " "), "_n": F.size("_t")})
    token = lambda c, i: F.element_at(F.col(c), i)
    wanted = lambda i: F.array_contains(F.col("_want"), token("_f", i))
    s = s.withColumn("_at", F.when(F.col("_n") > 0, F.filter(F.sequence(F.lit(1), F.col("_n")), wanted)))
    scored = F.transform("_at", lambda i: F.struct(F.size(F.array_intersect("_want", F.slice("_f", i, F.lit(window)))).alias("n"), (-i).alias("i")))
    s = s.withColumn("_first", F.greatest(F.lit(1), F.least(F.coalesce(-F.array_max(scored)["i"], F.lit(1)), F.col("_n") - window + 1)))
    s = s.withColumn("_last", F.least("_n", F.col("_first") + window - 1))
    mark = lambda i: F.when(wanted(i), F.concat(F.lit("«"), token("_t", i), F.lit("»"))).otherwise(token("_t", i))
    after = lambda i: F.when((i < F.col("_last")) | (F.col("_last") == F.col("_n")), token("_gap", i)).otherwise(" … ")
    shown = F.array_join(F.transform(F.sequence("_first", "_last"), lambda i: F.concat(mark(i), after(i))), "")
    before = F.when(F.col("_first") > 1, "… ").otherwise(F.regexp_extract("_text", BEFORE_RE, 0))
    return s.select(*hits.columns, F.when(F.col("_n") > 0, F.concat(before, shown)).otherwise(F.substring("_text", 1, 200)).alias("snippet"))


# ---------------------------------------------------------------- vectors


def l2_normalize(v: Column) -> Column:
    """Doubles of norm 1; a vector of norm 0 or not finite is unchanged."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a.cast("array<double>"), F.lit(1), n), F.slice(b.cast("array<double>"), F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of norm 1 of a list array, cut or filled with 0 to ``dim``; a row of
    norm 0 or not finite is unchanged, a null one 0."""
    sizes = _sizes(lists)
    flat = np.asarray(lists.flatten().fill_null(0.0), np.float64)
    row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    norm = np.sqrt(np.bincount(row, flat * flat, len(sizes)))
    scale = np.where((norm > 0) & (norm < np.inf), norm, 1.0)
    place = np.arange(len(flat)) - np.repeat(first, sizes)
    out, inside = np.zeros((len(sizes), dim)), place < dim
    out[row[inside], place[inside]] = (flat / scale[row])[inside]
    return out


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", query_block: int = 256, max_query_bytes: int = 256 << 20) -> DataFrame:
    """queries (query_id, qvec) against all ``vectors``: the ``k`` largest dot
    products of normalised vectors per query, (query_id, id, score, rank),
    ties by id.

    Exact: each batch of vectors is multiplied with blocks of the query matrix
    and keeps its k best per query, so a batch sends at most k rows per query
    on; the query matrix is checked against ``max_query_bytes`` before it is
    sent to the executors, and a larger query set goes in several runs.
    """
    schema = T.StructType([queries.schema["query_id"], vectors.schema[id_col], T.StructField("score", T.DoubleType())])
    n_q, dim = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    runs = max(1, -(-int(n_q) * int(dim) * 8 // max_query_bytes))
    out = None
    for r in range(runs):
        part = queries if runs == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(runs)) == r)
        rows = part.select("query_id", l2_normalize(F.col("qvec")).alias("q")).collect()
        qid = [x["query_id"] for x in rows]
        mat = np.zeros((len(rows), max((len(x["q"]) for x in rows), default=0)))
        for i, x in enumerate(rows):
            mat[i, : len(x["q"])] = x["q"]
        bc = vectors.sparkSession.sparkContext.broadcast((qid, mat))

        def run(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            ids, m = bc.value
            for b in batches:
                x, keys = _matrix(b.column(vec), m.shape[1]), b.column(id_col)
                if not len(x) or not ids:
                    continue
                order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
                order = order[_sizes(b.column(vec))[order] > 0]
                x, key = x[order], keys.take(pa.array(order)).to_pylist()
                if not key:
                    continue
                oq, ok_, os = [], [], []
                for a in range(0, len(ids), query_block):
                    s = np.round(m[a : a + query_block] @ x.T, 9)
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    for i, row in enumerate(best):
                        oq += [ids[a + i]] * len(row)
                        ok_ += [key[j] for j in row]
                        os += s[i, row].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(oq), pa.array(ok_), pa.array(os, pa.float64())], names=["query_id", id_col, "score"])

        got = vectors.select(id_col, vec).mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), id_col))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- fusion


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = 10, id_col: str = "doc_id", c: int = RRF_K) -> DataFrame:
    """Two rank lists (query_id, id, rank from 1) fused: the sum of
    1 / (c + rank); ties keep lexical hits first, then by rank."""
    both = lexical.select("query_id", id_col, "rank", F.lit(0).alias("src")).unionByName(semantic.select("query_id", id_col, "rank", F.lit(1).alias("src")))
    fused = both.groupBy("query_id", id_col).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("src", "rank")).alias("_first"),
        F.max(F.when(F.col("src") == 0, F.col("rank"))).alias("lexical_rank"),
        F.max(F.when(F.col("src") == 1, F.col("rank"))).alias("semantic_rank"),
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_first.src"), F.col("_first.rank"))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_first")


def hybrid(queries: DataFrame, units: DataFrame, vectors: DataFrame | None, k: int = 10, id_col: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Lexical and vector search fused and hydrated: (query_id, rank, id,
    score, mode, excerpt).

    queries: query_id, query, qvec (null or absent: that query stays lexical,
    mode ``lexical``).  Ids without a unit are dropped after the limit.
    ``index`` is a stored index of the units (``index_rows``).
    """
    lex = bm25(queries, units, k, id_col, text, index=index, stats=None if index is None else index_stats(index))
    if vectors is None or "qvec" not in queries.columns:
        fused = lex.withColumn("_mode", F.lit("lexical"))
    else:
        sem = vector_topk(queries.filter(F.col("qvec").isNotNull()).select("query_id", "qvec"), vectors, k, id_col)
        have = queries.select("query_id", F.when(F.col("qvec").isNotNull(), "hybrid").otherwise("lexical").alias("_mode"))
        fused = rrf(lex, sem, k, id_col).join(have, "query_id")
    # a query has k hits: few enough to send to the texts, unless there are very many queries
    if queries.count() * k <= MAX_HITS_SENT:
        fused = F.broadcast(fused)
    out = units.select(id_col, F.col(text).alias("_text")).join(fused, id_col)
    return out.select("query_id", "rank", id_col, F.round("score", 9).alias("score"), F.col("_mode").alias("mode"), dense_excerpt("_text").alias("excerpt"))


def missing_vectors(units: DataFrame, vectors: DataFrame, space: str | None = None, id_col: str = "doc_id", vec_id: str = "vec_id", text: str = "text") -> DataFrame:
    """Units with text that lack a vector in the space."""
    v = vectors if space is None or "model" not in vectors.columns else vectors.filter(F.col("model") == space)
    have = v.select(F.col(vec_id).alias(id_col))
    return units.filter(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0).join(have, id_col, "left_anti")


def retrieval_text(c: Column, kind: str, most: int = 6000) -> Column:
    """Text for an embedder: a prefix for its side of the search, cut."""
    prefix = {"query": "task: search result | query: ", "document": "title: none | text: "}[kind]
    return F.concat(F.lit(prefix), F.substring(c, 1, most))
