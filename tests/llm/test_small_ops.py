"""Operators that are checked against brute-force versions on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import gif, language_id, line_templates, mixing, ngram_join, ordinal_quality, packing, repetition, sharding, substring_dedup, words

from tests_llm_helpers import WORD, brute_components, brute_targets, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).repartition(3).cache()


# ---------------------------------------------------------------- words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\né漢A\x1c."), max_size=25), min_size=1, max_size=5))
def test_words_match_the_rule(texts):
    arr = pa.array(texts, pa.string())
    w = words.Words(*words.buffers(arr))
    got = [w.buf[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in WORD.findall(t)]
    assert w.counts().tolist() == [len(WORD.findall(t)) for t in texts]
    h = dict(zip(w.hashes().tolist(), got))
    assert len(h) == len(set(got))
    keep = np.arange(len(got)) % 2 == 0
    flat = iter(keep.tolist())
    assert w.join_kept(keep).to_pylist() == [" ".join(x for x in WORD.findall(t) if next(flat)) for t in texts]


# ---------------------------------------------------------------- substring dedup


def brute_substring(rows, k=20):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in seen:
                gone[a : a + k] = [True] * k
            seen.add(tuple(w[a : a + k]))
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("depth,cells", [(2, 4), (1, 1)])
def test_substring_dedup(spark, docs, depth, cells):
    out = substring_dedup.substring_dedup(docs.withColumn("n_words", F.lit("clash")), depth=depth, cells_per_window=cells, block_bytes=4000)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == brute_substring(corpus())
    assert "source" in out.columns


def test_substring_repeated_rows_nulls_and_empty(spark, docs):
    text = " ".join("x%d" % i for i in range(30))
    df = table(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, text, "s")])
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, 0), (1, 30), (1, 30), (2, 30)]
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- n-gram join


def test_ngram_components(spark, docs):
    out = ngram_join.ngram_components(docs.select("doc_id", "text"), block_bytes=4000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(corpus())


@pytest.mark.parametrize("stars,part", [(0, 3), (2, 512)])
def test_ngram_chains_at_the_threshold(spark, stars, part):
    """Chains of edits, where a hub reaches few members: any mix of star
    rounds and the final pass gives the same components."""
    rnd = random.Random(9)
    rows, w = [], ["c%d" % i for i in range(60)]
    for i in range(40):
        w = w[:]
        for _ in range(rnd.randint(1, 2)):
            w[rnd.randrange(60)] = "n%d_%d" % (i, rnd.randrange(10**6))
        rows.append((2**60 + i, " ".join(w), "s"))
    df = table(spark, [*rows, (None, " ".join(w), "s")]).select("doc_id", "text")
    link = ngram_join.link_components
    ngram_join.link_components = lambda sets, percent: link(sets, percent, stars, part)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect() if r.doc_id is not None}
    finally:
        ngram_join.link_components = link
    assert got == brute_components(rows)


def test_ngram_edges_of_input(spark, docs):
    df = table(spark, [(None, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (3, "A b c d e f", "s"), (4, None, "s")])
    got = sorted(((r.doc_id or -1), r.component_id) for r in ngram_join.ngram_components(df).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (3, 1), (4, 4)]
    assert {r.doc_id for r in ngram_join.one_of_each(df).collect()} == {None, 1, 4}
    assert ngram_join.ngram_components(docs.limit(0).select("doc_id", "text")).count() == 0


def test_ngram_equal_ids(spark):
    """Repeated rows with partners aren't multiplied, and different texts of
    one id are one document with the links of all of them."""
    near = lambda c, j=None: " ".join("%s%d" % (c, i) if i != j else "edit" for i in range(60))
    rows = [(1, near("a")), (1, near("a")), (1, near("a")), (2, near("a", 20))]
    rows += [(10, near("b")), (10, near("c")), (10, near("c")), (11, near("b", 0)), (12, near("c", 59))]
    rows += [(20, near("d")), (21, near("e")), (22, near("d")), (22, near("e")), (23, near("e", 0))]
    rows += [(30, near("f")), (30, near("g"))]
    df = table(spark, [(i, t, "s") for i, t in rows]).select("doc_id", "text")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_components(df).collect())
    assert got == [(i, i // 10 * 10 or 1) for i, _ in rows]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == [1, 1, 1, 10, 10, 10, 20, 30, 30]


# ---------------------------------------------------------------- repetition


def test_quality_rules(spark, docs):
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for i, t, _ in corpus():
        t = t or ""
        w = WORD.findall(t)
        seen = defaultdict(list)
        for p in range(len(w) - 7):
            seen[tuple(w[p : p + 8])].append(p)
        cov = {q for v in seen.values() if len(v) > 1 for p in v for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 20 or 100 * len(cov) > 30 * len(w)) and (not r.base_failed or not r.kept)
        best = max((b - a for a in range(len(w)) for b in range(a + 8, min(len(w), a + 40) + 1) if sum(w[x : x + b - a] == w[a:b] for x in range(len(w))) > 1), default=0) if len(w) < 130 else r.longest_repeat
        assert r.longest_repeat == best or best >= 39
    assert repetition.quality_rules(docs.limit(0)).count() == 0


def test_long_repetitive_text():
    """A text of 300,000 words, repeated and not, in bounded memory."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = " ".join("w%d" % (i % 977) for i in range(300_000)) + " " + " ".join("u%d" % i for i in range(1000))
    got = repetition._features(8)(pa.array([text, "a b", None]))
    assert got["n_words"].to_pylist() == [301_000, 2, 0] and got["n_repeat_words"].to_pylist() == [300_000, 0, 0]
    assert got["longest_repeat"].to_pylist() == [300_000 - 977, 0, 0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150 * 1024  # kB: under 60 bytes for each byte of text


# ---------------------------------------------------------------- sharding and mixing


def test_results_replace_columns_of_their_names(spark, docs):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    clash = docs.withColumns({"shard": F.lit("x"), "slot": F.col("doc_id"), "offset": F.lit("y"), "sequence_id": F.lit(0)})
    out = sharding.shard_by_bytes(clash, size, [F.col("doc_id"), F.col("slot")], 4)
    assert out.count() == docs.count() and dict(out.dtypes)["shard"] == "int" and out.columns.count("slot") == 1
    rows = packing.pack(clash.select("offset", "sequence_id", "shard", F.lit(5).alias("length")), 64, block_rows=16)
    got = rows.collect()
    assert len(got) == docs.count() and dict(rows.dtypes)["offset"] == "bigint" and {r.offset % 5 for r in got} == {0}
    extra = docs.withColumns({"_x": F.lit(1), "n_words": F.lit("x"), "kept": F.lit("x"), "n_shingles": F.lit("x"), "component_id": F.lit("x"), "media": F.lit("x")})
    for f in (substring_dedup.substring_dedup, repetition.quality_rules, ngram_join.ngram_components, gif.gif_digests):
        made = f(extra)
        assert made.count() == docs.count() and len(set(made.columns)) == len(made.columns) and "_x" in made.columns


def test_shards(spark, docs):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    big = docs.crossJoin(spark.range(30).select(F.col("id").alias("k"))).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)) * 100 + F.col("k"))
    out = sharding.shard_by_bytes(big, size, [F.col("doc_id")], 24, first_bits=3, rows_per_cell=100).withColumn("size", size).toPandas()
    assert len(out) == big.count() and set(out.shard) == set(range(24))
    sums = out.groupby("shard")["size"].sum()
    assert (sums - sums.mean()).abs().max() <= 0.001 * sums.mean() + out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    same = spark.createDataFrame([(1, "x")] * 50 + [(None, None)] * 5, "doc_id long, text string")
    got = sharding.shard_by_bytes(same, size, [F.col("doc_id")], 4).collect()
    assert len(got) == 55 and sharding.shard_by_bytes(same.limit(0), size, [F.col("doc_id")]).count() == 0


def brute_sample(rows, share=1.5, most=2.0):
    """rows: (source, size, key): what each takes, by ordering whole sources."""
    sizes = defaultdict(int)
    for s, n, _ in rows:
        sizes[s] += n
    targets, took = brute_targets(sizes, share, most), [0] * len(rows)
    for s, target in targets.items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        rest, upto = target - epochs * sizes[s], 0
        for i in sorted((i for i, r in enumerate(rows) if r[0] == s), key=lambda i: rows[i][2]):
            upto += rows[i][1]
            took[i] = rows[i][1] * (epochs + (upto - rows[i][1] / 2 <= rest))
    return targets, took


@pytest.mark.parametrize("rows_per_bin,bin_bits,few", [(1_000, 10, True), (3, 2, True), (3, 5, False)])
def test_mix_is_a_weighted_sample(spark, docs, monkeypatch, rows_per_bin, bin_bits, few):
    """Every refinement of bins takes what ordering whole sources by key takes."""
    if not few:  # as with very many sources: no broadcast of the plan
        monkeypatch.setattr(mixing, "MOST_HOT", 0)
    d = docs.withColumns({"w": mixing.n_words(F.col("text")), "q": F.when(F.col("doc_id") % 3 == 0, 0.01).otherwise(mixing.quality_weight(F.col("text")))})
    d = d.withColumns({"target": F.lit("clash"), "taken": F.lit(1)})
    names = sorted(d.columns)
    u = (F.pmod(F.xxhash64(F.lit(17), *names), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(u) / F.greatest(F.coalesce("q", F.lit(0.25)), F.lit(1e-6))
    rows = d.select("doc_id", "source", "w", key.alias("k")).collect()
    targets, took = brute_sample([(r.source, r.w, r.k) for r in rows])
    out = mixing.mix_sources(d, F.col("w"), F.col("q"), rows_per_bin=rows_per_bin, bin_bits=bin_bits)
    got = out.collect()
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "w", "q", *mixing.MADE])
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, t) for r, t in zip(rows, took))
    assert all(abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and r.taken <= 2 * r["size"] for r in got)
    for s in targets:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - targets[s]) <= max(r["size"] for r in mine) / 2 + 1


def test_mix_reruns_ties_and_empty(spark, docs):
    size = F.lit(10)
    one = [("a", i % 7, "x%d" % (i % 5)) for i in range(60)]  # rows that repeat, ids that repeat with other texts
    df = spark.createDataFrame(one, "source string, doc_id long, text string")
    runs = [sorted((r.doc_id, r.text, r.taken) for r in mixing.mix_sources(x, size, F.lit(0.5), share=0.4).collect()) for x in (df, df.repartition(5), df.select("text", "doc_id", "source"))]
    assert runs[0] == runs[1] == runs[2] and abs(sum(t for _, _, t in runs[0]) - 240) <= 10
    assert mixing.mix_sources(docs.limit(0), size, F.lit(1.0)).count() == 0
    none = spark.createDataFrame([(None, 1, None)], "source string, doc_id long, text string")
    assert mixing.mix_sources(none, F.lit(None).cast("long"), F.lit(None).cast("double")).first().taken == 0


def test_better_documents_are_taken_more_often(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).alias("w"), F.when(F.col("id") % 4 < 2, 1.0).otherwise(0.25).alias("q"))
    out = mixing.mix_sources(d, F.col("w"), F.col("q"), share=0.4).filter("taken > 0").groupBy("q").count().collect()
    n = {r.q: r["count"] for r in out}
    assert n[1.0] > 1.5 * n[0.25]


# ---------------------------------------------------------------- packing


def test_tokens_equal_the_tokenizer():
    tok = packing.word_tokens(packing.tokenizer_path())
    rnd = random.Random(4)
    alphabet = "aB1é.,;:!?'|² ½́Σİ-\n\tñ<>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["a <|endoftext|> b", "", "x's. it's, “q”. naïve!"]
    for t in texts:
        assert tok.ids(t.encode()) == np.asarray(tok.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing_round_trip(spark, docs):
    twice = docs.unionByName(docs.filter("doc_id < 5"))
    pieces = packing.token_pieces(twice.select("doc_id", "text"), 512, with_ids=True)
    rows = packing.pack(pieces, 512, block_rows=32).toPandas()
    tok = packing.word_tokens(packing.tokenizer_path())
    want = Counter()
    for i, t, _ in corpus() + [r for r in corpus() if r[0] < 5]:
        ids = np.frombuffer(tok.ids((t or "").encode()), "<u4").tolist() + [0]
        for p, s in enumerate(range(0, len(ids), 512)):
            want[i, p, s, tuple(ids[s : s + 512])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows.itertuples()) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows.itertuples())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 512 and (g.length.cumsum() - g.length == g.offset).all()
    lens = rows.length.tolist()
    assert rows.sequence_id.nunique() <= len(packing.best_fit([], list(range(len(lens))), lens, 512)) + 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 100, 60).tolist(), reverse=True)
    a = packing.Grouping(packing.best_fit([], list(range(60)), lengths, 128), lengths, 128)
    b = packing.Grouping([[i] for i in range(60)], lengths, 128)
    for g in (packing.crossover(a, b, lengths, 128, rng), packing.crossover(b, a, lengths, 128, rng), packing.mutate(b, lengths, 128, rng)):
        assert sorted(i for x in g.bins for i in x) == list(range(60)) and max(g.fill) <= 128
    assert len(packing.evolve(lengths, 128, [], rng)[0].bins) <= len(a.bins)


# ---------------------------------------------------------------- media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8))
def test_lzw_round_trip(data, bits):
    data = bytes(x & ((1 << bits) - 1) for x in data)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def test_gif_of_another_encoder():
    """A 10 x 10 sample image that is widely used to explain the format."""
    raw = bytes.fromhex("474946383961 0a000a00 91 00 00 ffffff ff0000 0000ff 000000 21f904 00 0000 00 00 2c 0000 0000 0a00 0a00 00 02 16 8c2d99872a1cdc33a0027 5ec95faa8de608c04914c0100 3b".replace(" ", ""))
    f = gif.decode(raw)[0]
    assert f.indices.shape == (10, 10) and f.indices[0].tolist() == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and f.indices[3].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2]
    assert f.rgba[0, 0].tolist() == [255, 0, 0, 255]


def test_gif_disposal_transparency_interlace():
    def frame(idx, left, top, disposal, transparent=None, interlace=False):
        h, w = idx.shape
        rows = idx[gif._rows_of_interlaced(h)] if interlace else idx
        flags = disposal << 2 | (transparent is not None)
        out = b"\x21\xf9\x04" + bytes([flags]) + b"\x05\0" + bytes([transparent or 0]) + b"\0"
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 if interlace else 0]) + b"\x08"
        return out + gif._sub_blocks(gif.lzw_encode(rows.astype(np.uint8).tobytes()))

    base = np.arange(64).reshape(8, 8)
    small = np.array([[200, 201], [202, 203]])
    data = b"GIF89a\x08\0\x08\0\xf7\0\0" + gif.GREY + frame(base, 0, 0, 1, interlace=True) + frame(small, 1, 1, 3, 201) + frame(small, 4, 4, 2) + frame(small, 0, 0, 0, 200) + b"\x3b"
    a, b, c, d = gif.decode(data)
    assert (a.rgba[..., 0] == base).all() and a.delay_cs == 5
    assert b.rgba[1, 1, 0] == 200 and b.rgba[1, 2, 0] == base[1, 2]  # 201 is transparent
    assert c.rgba[1, 1, 0] == base[1, 1] and c.rgba[4, 4, 0] == 200  # restored to before b
    assert d.rgba[4, 4, 3] == 0 and d.rgba[0, 0, 0] == base[0, 0] and d.rgba[0, 1, 0] == 201  # c's area cleared
    assert gif.colour_histogram(a).sum() == 3 * 64


def test_gif_cut_short():
    """Any beginning of a file gives a beginning of its frames."""
    rng = np.random.default_rng(5)
    data = gif.encode(rng.integers(0, 40, 576 * 3, dtype=np.uint8).tobytes(), frame_rows=1)
    local = data[:-1] + b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0x80, 1, 2, 3, 4, 5, 6, 2]) + gif._sub_blocks(gif.lzw_encode(b"\x01\x00", 2)) + b"\x3b"
    whole = gif.decode(local)
    assert len(whole) == 4 and whole[3].rgba[0, :2].tolist() == [[4, 5, 6, 255], [1, 2, 3, 255]]
    for n in range(3, len(local)):
        got = gif.decode(local[:n])
        assert len(got) <= 4 and all((a.indices == b.indices).all() for a, b in zip(got[:-1], whole))
    with pytest.raises(ValueError):
        gif.decode(b"PNG")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(2, 8))
def test_lzw_of_any_bytes(stream, bits):
    assert len(gif.lzw_decode(stream, bits, 500)) <= 500


def test_gif_columns(spark, docs):
    got = {r.doc_id: r for r in gif.gif_digests(docs).collect()}
    full = {r.doc_id: r for r in gif.with_gif(docs.filter("doc_id < 20")).collect()}
    for i, t, _ in corpus():
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[i].payload_sha256 == hashlib.sha256(pay).hexdigest() and got[i].tail_crc32 == zlib.crc32(pay[-32:])
        if i in full:
            assert bytes(full[i].payload) == pay and hashlib.sha256(full[i].media).hexdigest() == got[i].media_sha256 and len(full[i].frames) == got[i].n_frames
    assert gif.gif_digests(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- models


def test_language_mixture(spark):
    rnd = random.Random(3)
    langs = {"xx": ["ba", "da", "lor", "mun"], "yy": ["ri", "sti", "ke", "ñu"], "zz": ["ghü", "och", "tz", "pf"]}
    word = lambda k: "".join(rnd.choice(langs[k]) for _ in range(rnd.randint(2, 4)))
    rows = [(i, " ".join(word(k) for _ in range(40)), k, "s", 1) for i in range(120) for k in [sorted(langs)[i % 3]]]
    df = spark.createDataFrame(rows, SCHEMA)
    names, tab = language_id.train(df.filter("doc_id < 90"))
    assert names == ["xx", "yy", "zz"]
    mixed = " ".join(word("xx") for _ in range(60)) + " " + " ".join(word("zz") for _ in range(40))
    test = spark.createDataFrame([r for r in rows if r[0] >= 90] + [(900, mixed, None, None, 0), (901, None, None, None, 0), (902, "12 !!", None, None, 0), (903, "", None, None, 0)], SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(test.withColumn("score", F.lit("clash")), names, tab).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows if r[0] >= 90)
    assert got[900].lang_pred == "xx" and set(got[900].lang_set) == {"xx", "zz"} and abs(got[900].score - 0.6) < 0.1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (901, 902, 903))
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(test, *none).collect()} == {"und"}


def test_language_sets_of_any_size():
    """A text of all learned languages has all of them in its set."""
    rnd = random.Random(4)
    langs = {"vv": "abc", "ww": "def", "xx": "ghi", "yy": "jkl", "zz": "mno"}
    text = lambda k, n: " ".join("".join(rnd.choices(langs[k], k=6)) for _ in range(n))
    names = sorted(langs)
    counts = language_id.count_table(pa.array([text(k, 2000) for k in names]), np.arange(5), 5) + 0.1
    tab = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    texts = [" ".join(text(k, 30 + 10 * (k == "xx")) for k in names[:n]) for n in (1, 2, 3, 4, 5)]
    pred, score, sets = language_id.infer(pa.array([*texts, None, "a"]), names, tab)
    assert [set(x) for x in sets[:5]] == [set(names[:n]) for n in (1, 2, 3, 4, 5)] and sets[5] is None and sets[6] == ["vv"]
    assert [pred[n] for n in (2, 3, 4)] == ["xx"] * 3 and np.abs(score[2:5] - [0.4, 40 / 130, 0.25]).max() < 0.02


def test_ordinal_gradient_and_order():
    rnd = np.random.default_rng(2)
    texts, grades = [], []
    for i in range(300):
        g = i % 3
        texts.append(" ".join(["vile"] * (g == 0) + ["dull"] * (g == 1) * 2 + [f"k{x}" for x in rnd.integers(0, 30, 20)]))
        grades.append(g)
    f = ordinal_quality.text_features(pa.array(texts))
    m = ordinal_quality.fit_ordinal(*f, np.array(grades), 3)
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(m.margins(*f))
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails >= 0.5).sum(1) == np.array(grades)).mean() > 0.95


def test_ordinal_columns(spark, docs):
    rated = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    model = ordinal_quality.train(rated, docs, 3)
    out = ordinal_quality.score(docs.withColumn("tail_1", F.lit("clash")), model).collect()
    assert len(out) == len(corpus()) and all(0 <= r.tail_2 <= r.tail_1 <= 1 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-9 for r in out)
    empty = ordinal_quality.train(rated.limit(0), docs, 3)
    assert ordinal_quality.score(docs.limit(0), empty).count() == 0
