"""The queries themselves, on a written table: columns, types, constants, and
whatever a reader of the contract can compute without the operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from evidentia.llm import gif, language_id, packing, registry

from test_small_ops import brute_sample, brute_substring  # noqa: F401
from tests_llm_helpers import WORD, brute_components, brute_targets, corpus

TYPES = {
    "op1_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_histogram_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_gif_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op6_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_pack_sequences": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op12_role_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
}
TEXTS = [(i, t, s) for i, t, s in corpus(100, 11)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, texts in (("full", TEXTS), ("empty", [])):
        rows = [(i, t, "en" if i % 3 else "xx", s, None if t is None else len(t)) for i, t, s in texts]
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(root / name / "documents.parquet"))
        talk = [(i // 3, i % 3, "user" if i % 3 else "assistant", t) for i, t, _ in texts]
        spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(root / name / "conversations.parquet"))
        spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i, _, _ in texts], "doc_id long, quality int, toxic int").write.parquet(str(root / name / "labels.parquet"))
    return root


@pytest.fixture(scope="module")
def results(spark, tables):
    return {n: registry.QUERIES[n](spark, str(tables / "full")) for n in registry.QUERIES}


@pytest.mark.parametrize("name", TYPES)
def test_columns(results, name):
    have = dict(results[name].dtypes)
    assert {c: have.get(c) for c in TYPES[name]} == TYPES[name]


@pytest.mark.parametrize("name", [*registry.QUERIES, "pipeline"])
def test_empty_tables(spark, tables, name):
    q = registry.QUERIES.get(name, corpus_pipeline.run)
    assert q(spark, str(tables / "empty")).count() == 0


def test_substring(results):
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute_substring(TEXTS).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in results["op1_substring_dedup"].collect()} == want


def test_shards(results):
    got = results["op3_histogram_shards"].collect()
    raw = {i: (t or "").encode() for i, t, _ in TEXTS}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(x) + 8, zlib.crc32(x)) for i, x in raw.items()}
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 24 for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_media(results):
    """The stored form is built here from the format's rules alone, by an
    encoder that never fills a table: a clear code before every 100 samples."""
    by_text = {}
    for r in results["op5_gif_media"].collect():
        t = dict((i, t) for i, t, _ in TEXTS)[r.doc_id]
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        media = gif.encode(pay)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        bins = [sum(x // 32 == b for x in pay) for b in range(8)]
        assert r.feature == ",".join(map(str, bins)) and r.n_frames == -(-len(pay) // (576 * 64))
        assert by_text.setdefault(t or "", r[1:]) == r[1:]
        if len(pay) <= 576 * 4:
            assert plain_lzw(media) == pay


def plain_lzw(media):
    """A decoder of one frame that keeps to the text of the format: codes one
    by one from a bit string."""
    at = 13 + 768 + 8 + 10
    size, at, stream = media[at], at + 1, b""
    while media[at]:
        stream += media[at + 1 : at + 1 + media[at]]
        at += 1 + media[at]
    bits, place, clear, out = int.from_bytes(stream, "little"), 0, 1 << size, []
    while True:
        table, width, prev = {i: [i] for i in range(clear)}, size + 1, None
        table[clear] = table[clear + 1] = []
        while True:
            code, place = bits >> place & ((1 << width) - 1), place + width
            if code in (clear, clear + 1):
                break
            entry = table[code] if code in table else prev + prev[:1]
            if prev is not None and len(table) < 4096:
                table[len(table)] = prev + entry[:1]
            out += entry
            prev = entry
            if len(table) == 1 << width and width < 12:
                width += 1
        if code == clear + 1:
            return bytes(out)


def test_mix(results):
    got, sizes, by_source = results["op6_mix_sources"].collect(), {}, {}
    words = {i: (len(WORD.findall(t or "")), s) for i, t, s in TEXTS}
    for n, s in words.values():
        sizes[s] = sizes.get(s, 0) + n
    targets = brute_targets(sizes)
    for r in got:
        n, s = words[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and abs(r.target - targets[s]) < 1e-6 and r.taken in (0, n, 2 * n)
        by_source[s] = by_source.get(s, 0) + r.taken
    assert all(abs(by_source[s] - targets[s]) <= max(n for n, x in words.values() if x == s) / 2 + 1 for s in targets)


def test_rules(results):
    for r in results["op7_quality_rules"].collect():
        t = dict((i, t) for i, t, _ in TEXTS)[r.doc_id] or ""
        w = WORD.findall(t)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and (not r.base_failed or not r.kept)


def test_packing(results):
    tok = packing.word_tokens(packing.tokenizer_path())
    ids = {i: np.asarray(tok.tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t, _ in TEXTS}
    got = results["op8_pack_sequences"].toPandas()
    want = {(i, p, 2048 * p, len(x[2048 * p : 2048 * (p + 1)]), zlib.crc32(x[2048 * p : 2048 * (p + 1)].tobytes())) for i, x in ids.items() for p in range(-(-len(x) // 2048))}
    assert set(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()


def test_components(results):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in results["op9_ngram_join"].collect()} == brute_components(TEXTS)


def test_languages(spark, results, tmp_path_factory):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    got = results["op10_language_id"].collect()
    assert all(r.held_out == held(r.doc_id) and r.lang_pred in ("en", "xx", "und") and 0 <= r.score <= 1 for r in got)
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _ in TEXTS}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got)
    # nothing of the held-out rows is learned: their languages and other ids change no prediction
    root = tmp_path_factory.mktemp("changed")
    rows = [(i, t, "en" if i % 3 else "xx", s, 0) for i, t, s in TEXTS]
    spark.createDataFrame([(i, t, "zz" if held(i) else lang, "other", n) for i, t, lang, s, n in rows], SCHEMA).write.parquet(str(root / "documents.parquet"))
    again = language_id.op10_language_id(spark, str(root)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_quality_columns(results):
    got = results["op4_ordinal_quality"].collect()
    assert len(got) == len(TEXTS) and all(0 <= r.tail_2 <= r.tail_1 <= 1 and r.kept == (r.tail_2 >= 0.25) for r in got)


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    """Language on held-out documents, and quality on held-out ratings."""
    from pyspark.sql import functions as F

    from evidentia.llm import ordinal_quality as oq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", oq.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = oq.train(labels.filter(~held), docs.select("doc_id", "text"), 3)
    rated = oq.score(docs.select("doc_id", "text"), model).join(labels.filter(held), "doc_id").filter("grade IS NOT NULL")
    keep, good = F.col("tail_2") >= oq.KEEP_FROM, F.col("grade") == 2
    r = rated.agg(F.avg(F.when(good, keep.cast("double"))).alias("kept"), F.avg(F.when(F.col("grade") == 0, keep.cast("double"))).alias("toxic"), F.corr("expected_grade", F.col("grade").cast("double")).alias("corr")).first()
    assert r.kept >= 0.95 and r.toxic <= 0.1 and r["corr"] >= 0.6, r
