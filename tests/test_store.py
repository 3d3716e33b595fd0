"""The store under concurrent writers, leases, control files."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evidentia.config import Settings, number
from evidentia.sources import store as st
from evidentia.sources.files import Files, contained, safe_name
from evidentia.sources.store import Store
from evidentia.streaming.ingest import Lease, requeue

COLS = "case_id string, page int, state string, ocr_yield string, ocr_prompt_version int"


def ledger(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], COLS)


def test_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("page_ledger").count() == 0
    s.upsert("page_ledger", ledger(spark, [("a", 1, "x"), ("b", 1, "x"), ("a", 2, "x")]))
    s.upsert("page_ledger", ledger(spark, [("a", 1, "y"), ("c", 1, "x")]))
    s.patch("page_ledger", spark.createDataFrame([("b", 1, "z"), ("zz", 1, "z")], "case_id string, page int, state string"))
    s.delete("page_ledger", spark.createDataFrame([(2,)], "page int"), ["page"])
    s.append("page_ledger", ledger(spark, [("a", 9, "x")]))
    got = lambda df: sorted((r.case_id, r.page, r.state) for r in df.collect())
    assert got(s.read("page_ledger")) == [("a", 1, "y"), ("a", 9, "x"), ("b", 1, "z"), ("c", 1, "x")]
    assert got(s.read("page_ledger", "a")) == [("a", 1, "y"), ("a", 9, "x")] and got(s.read("page_ledger", "none")) == []
    files = s.read("page_ledger", "a").inputFiles()
    assert files and len(files) < len(s.read("page_ledger").inputFiles())
    s.write("page_ledger", ledger(spark, [("q", 1, "x")]))
    assert got(s.read("page_ledger")) == [("q", 1, "x")]


@pytest.mark.parametrize("cases", [("a", "b", "c", "d"), ("a", "a", "a", "a")])
def test_concurrent_writers_lose_nothing(spark, tmp_path, cases):
    root = str(tmp_path)
    Store(spark, root).upsert("page_ledger", ledger(spark, [(c, 0, "old") for c in sorted(set(cases))]))

    def work(k):
        s = Store(spark, root)
        s.upsert("page_ledger", ledger(spark, [(cases[k], 0, f"w{k}"), (cases[k], k + 1, "new")]))
        s.append("ocr_usage", spark.createDataFrame([(cases[k], k, k)], "case_id string, tokens_in long, tokens_out long"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    rows = Store(spark, root).read("page_ledger").collect()
    assert {(r.case_id, r.page) for r in rows if r.state == "new"} == {(c, k + 1) for k, c in enumerate(cases)}
    assert sorted((r.case_id, r.page) for r in rows if r.page == 0) == [(c, 0) for c in sorted(set(cases))]
    assert st.usage_totals(Store(spark, root).read("ocr_usage")).agg(F.sum("tokens_in")).first()[0] == 6


def test_old_versions_go_and_buckets_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "MAX_FOLDERS", 3)
    monkeypatch.setattr(st, "KEPT_VERSIONS", 2)
    monkeypatch.setattr(st, "KEPT_MS", -1000)
    s = Store(spark, str(tmp_path))
    for k in range(9):
        s.upsert("page_ledger", ledger(spark, [("a", k, "x")]))
    n, entry = s._entry("page_ledger")
    assert n == 9 and all(len(f) <= 3 for f in entry.values()) and s.read("page_ledger").count() == 9
    assert len(s._versions("page_ledger")) <= 4


def test_exclusive_creation(spark, tmp_path):
    f, path = Files(spark), str(tmp_path / "d" / "one")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: f.create(path, f"writer {k}"), range(8)))
    assert won.count(True) == 1 and f.read(path) == f"writer {won.index(True)}"
    assert f.read(path + "x") is None and f.names(str(tmp_path / "d")) == ["one"]


def test_lease_has_one_owner(spark, tmp_path):
    a, b = (Lease(spark, str(tmp_path), "c/../1") for _ in range(2))
    assert a.acquire() and a.acquire() and not b.acquire() and a.renew() and a.owns() and not b.renew()
    a.release()
    assert not a.owns() and b.acquire()
    stale = [Lease(spark, str(tmp_path), "c/../1", deadline_ms=-1000) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda x: x.acquire(), stale))
    owners = [x for x in stale if x.owns()]
    assert len(owners) == 1 and won[stale.index(owners[0])] and not b.owns()
    b.release()
    assert owners[0].owns()


def test_requeue_once_per_prompt_version(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.upsert("page_ledger", ledger(spark, [("a", 1, "ocr_done", "stamp_only", 1), ("a", 2, "ocr_done", "content", None), ("a", 3, "done"), ("b", 1, "ocr_done", "stamp_only", 1)]))
    assert requeue(s, 1, "a") == 0 and requeue(s, 2, "a") == 2 and requeue(s, 2, "a") == 0
    assert sorted((r.case_id, r.page, r.state, r.ocr_prompt_version) for r in s.read("page_ledger").collect()) == [("a", 1, "ocr_needed", 2), ("a", 2, "ocr_done", 2), ("a", 3, "done", None), ("b", 1, "ocr_done", 1)]


def test_paths_stay_below_the_root():
    assert contained("/r", "a/b", "c") == "/r/a/b/c" and contained("hdfs://x/r/", "a") == "hdfs://x/r/a"
    for bad in ("..", "a/../../b", "/etc", "file:x", "", "~x", "a\\b"):
        with pytest.raises(ValueError):
            contained("/r", bad)
    assert safe_name("case-1") == "case-1" and "/" not in safe_name("a/b") and safe_name("..") != ".."


def test_settings():
    env = {"EVIDENTIA_ROOT": " /r ", "EVIDENTIA_RETRIES": "-1", "OLD_CONCURRENCY": "7", "EVIDENTIA_APPROVAL_THRESHOLD": "nan"}
    assert Settings.from_env(env, "OLD_") == Settings("/r", 7, 3, 25) and number({"X": "0"}, 5, "X") == 0
    with pytest.raises(ValueError):
        Settings.from_env({})


def scanned_rows(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    todo, n = [plan], 0
    while todo:
        p = todo.pop()
        if p.metrics().contains("numOutputRows") and "FileSourceScan" in p.getClass().getSimpleName():
            n += p.metrics().apply("numOutputRows").value()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return n


def units_of(spark, rows):
    return spark.createDataFrame(rows, "evidence_id string, case_id string, text string")


def test_index_reads_what_a_search_asks_for(spark, tmp_path, monkeypatch):
    """A search of one term reads a fraction of the postings, and its statistics
    a few rows, whatever the number of units."""
    from evidentia.operators import search as se
    from evidentia.streaming.ingest import index_units

    monkeypatch.setitem(st.SORTED, "postings", (("case_id", "term"), 64 << 10))
    s = Store(spark, str(tmp_path), buckets=2)
    units = spark.range(3000).selectExpr("concat('e', id) AS evidence_id", "'a' AS case_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', (id * 31 + i * 977) % 5000))) AS text").persist()
    index_units(s, units)
    index = s.read("postings", "a")
    n = index.count()
    assert n == 3000 * 41 + 1
    assert 0 < scanned_rows(index.filter(F.col("term").isin("w77", "w4999"))) < n / 3
    assert scanned_rows(index.filter("term IS NULL")) < n / 3
    q = spark.createDataFrame([("q", "w77 w1054"), ("r", "w4999")], "query_id string, query string")
    got = se.bm25(q, None, 10, "evidence_id", index=index, stats=se.index_stats(index)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, se.bm25(q, units, 10, "evidence_id").collect()))


def test_index_statistics_are_additive(spark, tmp_path):
    """New, changed, emptied and repeated units; an interrupted batch run again."""
    from evidentia.operators import search as se
    from evidentia.streaming.ingest import index_units

    s = Store(spark, str(tmp_path), buckets=4)
    now = {}
    for rows in (
        [("a1", "a", "one two three"), ("a2", "a", ""), ("b1", "b", "one")],
        [("a1", "a", "one"), ("a3", "a", "four five")],
        [("a1", "a", "one"), ("a3", "a", "four five")],
        [("a2", "a", None), ("c1", "c", "x y z"), ("b1", "b", "two two")],
    ):
        index_units(s, units_of(spark, rows))
        now |= {i: (c, t) for i, c, t in rows}
        stats = {r.case_id: (r.n_docs, round(r.avg_dl, 9)) for r in se.index_stats(s.read("postings"), ["case_id"]).collect()}
        want = {}
        for c, t in now.values():
            if t is not None:
                want.setdefault(c, []).append(len(t.split()))
        assert stats == {c: (len(x), round(sum(x) / len(x), 9)) for c, x in want.items()}
        assert {(r.evidence_id, r.term, r.tf) for r in s.read("postings").filter("term <> ''").collect()} == {(i, w, t.split().count(w)) for i, (c, t) in now.items() if t for w in t.split()}


def test_a_write_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    """The files that a small write looks at don't grow with the table."""
    s = Store(spark, str(tmp_path), buckets=16)
    s.upsert("page_ledger", ledger(spark, [(f"c{i}", p, "x") for i in range(200) for p in range(3)]))
    looked = []
    frame = Store._frame
    monkeypatch.setattr(Store, "_frame", lambda self, table, entry, buckets=None: looked.append(None if buckets is None else len(list(buckets))) or frame(self, table, entry, buckets))
    s.upsert("page_ledger", ledger(spark, [("c7", 1, "y"), ("c7", 9, "y")]))
    s.patch("page_ledger", ledger(spark, [("c8", 1, "z")]))
    s.delete("page_ledger", spark.createDataFrame([("c9", 0)], "case_id string, page int"), ["case_id", "page"])
    s.near("page_ledger", spark.createDataFrame([("c9",)], "case_id string")).count()
    assert looked and all(n is not None and n <= 1 for n in looked)
    assert s.read("page_ledger").count() == 600
    assert Store(spark, str(tmp_path)).n_buckets == 16  # whoever opens it


def test_young_versions_stay(spark, tmp_path, monkeypatch):
    """A reader that began some versions ago still finds its files."""
    monkeypatch.setattr(st, "KEPT_VERSIONS", 1)
    s = Store(spark, str(tmp_path))
    s.upsert("page_ledger", ledger(spark, [("a", 1, "old")]))
    early = s.read("page_ledger")
    for k in range(6):
        s.upsert("page_ledger", ledger(spark, [("a", 1, f"v{k}")]))
    assert [r.state for r in early.collect()] == ["old"] and s.read("page_ledger").first().state == "v5"


def test_postings_are_counted_without_an_exchange(spark):
    from collections import Counter

    from evidentia.operators.search import index_rows

    texts = ["Ação e acao, e", "", None, "x " * 700 + "y", "!!", "é É e"]
    df = spark.createDataFrame([(f"e{i}", "c", t) for i, t in enumerate(texts)] * 1, "evidence_id string, case_id string, text string")
    rows = index_rows(df, "evidence_id", "text", ("case_id",))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {"e0": ["acao", "e", "acao", "e"], "e1": [], "e2": [], "e3": ["x"] * 700 + ["y"], "e4": [], "e5": ["e"] * 3}
    got = {(r.case_id, r.evidence_id, r.dl, r.term, r.tf) for r in rows.collect()}
    assert got == {("c", k, len(ts), w, n) for k, ts in want.items() for w, n in [*Counter(ts).items(), ("", 1)]}


def test_postings_are_written_where_their_texts_were_dealt(spark, tmp_path, monkeypatch):
    """Texts go through an exchange, their postings don't; a large bucket is
    several tasks; what a write replaces is found by the units' own rows."""
    from evidentia.operators import search as se
    from evidentia.streaming.ingest import index_units

    monkeypatch.setattr(st, "TASK_CHARS", (2000, 2000))
    placed, held = [], []
    put, buckets = Store._put, Store._buckets
    monkeypatch.setattr(Store, "_put", lambda self, table, df, new=None: placed.append(new) or put(self, table, df, new))
    monkeypatch.setattr(Store, "_buckets", lambda self, df: held.append(df) or buckets(self, df))
    s = Store(spark, str(tmp_path), buckets=4)
    texts = {f"e{i}": (f"c{i % 7 * (i % 2)}", f"w{i} w{i % 5} a") for i in range(1200)}
    index_units(s, units_of(spark, [(k, *v) for k, v in texts.items()]).repartition(3).persist())
    texts |= {f"e{i}": (f"c{i % 7 * (i % 2)}", None if i % 3 else "b b") for i in range(0, 1200, 50)}
    index_units(s, units_of(spark, [(k, *texts[k]) for k in texts if int(k[1:]) % 50 == 0]))
    plan = placed[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    assert placed[0].rdd.getNumPartitions() > 4
    assert 0 < scanned_rows(held[-1]) < 1200 * 4
    want = {(k, c, w, t.split().count(w), len(t.split())) for k, (c, t) in texts.items() if t for w in {*t.split(), ""}}
    assert {(r.evidence_id, r.case_id, r.term, r.tf if r.term else 0, r.dl) for r in s.read("postings").filter("term IS NOT NULL").collect()} == want
    live = [(c, len(t.split())) for c, t in texts.values() if t]
    assert {(r.case_id, r.n_docs, round(r.avg_dl, 9)) for r in se.index_stats(s.read("postings"), ["case_id"]).collect()} == {(c, len(x), round(sum(x) / len(x), 9)) for c in {c for c, _ in live} for x in [[n for d, n in live if d == c]]}


def test_more_replaced_units_than_are_sent(spark, tmp_path, monkeypatch):
    from evidentia.streaming.ingest import index_units

    monkeypatch.setattr(st, "MAX_GONE_SENT", 3)
    s = Store(spark, str(tmp_path), buckets=2)
    index_units(s, units_of(spark, [(f"e{i}", "a", "x y") for i in range(20)]))
    index_units(s, units_of(spark, [(f"e{i}", "a", "z") for i in range(10)]))
    assert sorted((r.evidence_id, r.term) for r in s.read("postings").filter("term <> ''").collect()) == sorted([(f"e{i}", "z") for i in range(10)] + [(f"e{i}", w) for i in range(10, 20) for w in "xy"])


def test_runs_of_postings_are_in_order():
    import pyarrow as pa

    from evidentia.operators.search import sorted_postings

    rows = [("b", "e1", ["é", "a", "a"]), (None, "e2", []), ("a", "e3", ["z", "b"]), ("b", "e4", ["a"]), ("a", "e5", ["a"] * 9)]
    batch = pa.RecordBatch.from_pylist([{"case_id": c, "id": i, "_t": ts} for c, i, ts in rows], schema=pa.schema([("case_id", pa.string()), ("id", pa.string()), ("_t", pa.list_(pa.string()))]))
    for most in (1, 6, 100):
        runs = [r.to_pylist() for r in sorted_postings(batch, ["case_id"], "id", most)]
        for r in runs:
            keys = [(x["case_id"] or "~", x["term"].encode(), [i for _, i, _ in rows].index(x["id"])) for x in r]
            assert keys == sorted(keys)
        assert {(x["id"], x["term"], x["tf"], x["dl"]) for r in runs for x in r} == {(i, w, ts.count(w) or 1, len(ts)) for _, i, ts in rows for w in {*ts, ""}}
        assert len(runs) == {1: 5, 6: 3, 100: 1}[most]
