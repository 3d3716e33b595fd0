"""The pipeline's stages, one after the other, against brute-force versions."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from evidentia.llm import line_templates, packing
from tests_llm_helpers import WORD, brute_components, brute_targets, corpus

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's rows, written and read again as its successor's input."""
    root = tmp_path_factory.mktemp("stages")
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in corpus(180)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    docs, out = spark.read.parquet(str(root / "documents.parquet")), []
    out.append(docs)
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(root)).write.parquet(str(root / f"s{k}"))
        docs = spark.read.parquet(str(root / f"s{k}"))
        out.append(docs)
    return str(root), out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns_and_order(staged):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "source_mix", "packing"]
    assert all(df.columns == COLS for df in staged[1][:-1])


def test_rules_keep_what_is_clean(staged):
    before, after = rows_of(staged[1][0]), rows_of(staged[1][1])
    want = []
    for i, t, s in before:
        w = WORD.findall(t or "")
        seen = defaultdict(list)
        for p in range(len(w) - 7):
            seen[tuple(w[p : p + 8])].append(p)
        covered = {q for v in seen.values() if len(v) > 1 for p in v for q in range(p, p + 8)}
        longest = max((n for n in range(8, min(len(w), 60)) if len({tuple(w[a : a + n]) for a in range(len(w) - n + 1)}) < len(w) - n + 1), default=0)
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and longest <= 0.2 * len(w):
            want.append((i, t, s))
    assert sorted(after) == sorted(want)


def test_lines_equal_sql(staged):
    before, after = rows_of(staged[1][1]), rows_of(staged[1][2])
    c = duckdb.connect()
    c.register("t0", pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t, _ in before]))
    sql = "WITH " + line_templates.LINES_SQL.replace("{docs}", "t0") + " SELECT doc_id, CASE WHEN 10 * n_words_dropped >= 8 * n_words THEN text ELSE kept_text END FROM line_dedup JOIN t0 USING (doc_id)"
    assert sorted((i, t) for i, t, _ in after) == sorted(c.execute(sql).fetchall())


def test_one_of_each_group(staged):
    before, after = rows_of(staged[1][2]), rows_of(staged[1][3])
    want = {i for i, (_, c) in brute_components(before).items() if c == i}
    assert sorted(after) == sorted(r for r in before if r[0] in want)


def test_mix_meets_targets(staged):
    before, after = rows_of(staged[1][3]), rows_of(staged[1][4])
    n = Counter(i for i, _, _ in after)
    assert set(n.values()) <= {1, 2} and set(after) <= set(before)
    sizes, took, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in before:
        k = len(WORD.findall(t))
        sizes[s] += k
        took[s] += k * n[i]
        most[s] = max(most[s], k)
    for s, t in brute_targets(sizes).items():
        assert abs(took[s] - t) <= most[s] / 2 + 1


def test_packing_holds_every_token(staged):
    before = rows_of(staged[1][4])
    tok = packing.word_tokens(packing.tokenizer_path())
    want = Counter()
    for i, t, _ in before:
        n = len(np.frombuffer(tok.ids(t.encode()), "<u4")) + 1
        want.update((i, p, min(2048, n - p * 2048)) for p in range(-(-n // 2048)))
    out = staged[1][5].toPandas()
    assert Counter(zip(out.doc_id, out.piece, out.length)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()


def test_run_is_the_stages(spark, staged):
    root, out = staged
    got = cp.run(spark, root).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, out[5].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
