"""What has to hold when one group is very large: no window over all of it,
blocks that meet at their borders, few rows sent on."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import docmap as dm
from evidentia.operators import events as ev
from evidentia.operators import search as se
from evidentia.operators.running import numbered, running


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_against_a_list(spark, inclusive):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "b", None]), i, rnd.randint(0, 99) if rnd.random() < 0.8 else None) for i in rnd.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "k string, at int, v int").withColumns({"l0": F.floor(F.col("at") / 100), "l1": F.floor(F.col("at") / 7)})
    got = running(df, ["k"], ["l0", "l1"], ["at"], {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max"), "x": (F.col("v"), "xor")}, inclusive).collect()
    want = {}
    for k in {r[0] for r in rows}:
        s, m, x = 0, None, 0
        for _, at, v in sorted(r for r in rows if r[0] == k):
            before = (s, m, x)
            if v is not None:
                s, m, x = s + v, v if m is None else max(m, v), x ^ v
            want[k, at] = (s, m, x) if inclusive else before
    assert {(r.k, r["at"]): (r.s, r.m, r.x) for r in got} == want and len(got) == len(rows)


def test_numbers_of_one_large_group_come_from_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("c").alias("k"), F.col("id"), F.floor(F.col("id") / 1000).alias("b")).repartition(3)
    out = numbered(df, ["k"], ["b"], ["id"], "n")
    assert out.filter(F.col("n") != F.col("id") + 1).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["count"] for r in numbered(df, ["k"], ["b"], ["id"], "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 1 and max(per_task) < 20_000


def test_pages_and_documents_across_blocks(spark, monkeypatch):
    """Long, nested and overlapping documents over small blocks."""
    monkeypatch.setattr(dm, "PAGE_BLOCK", 4)
    rnd = random.Random(7)
    docs = [(c, str(i), a, a + rnd.choice([0, 1, 3, 30])) for c in "ab" for i, a in enumerate(rnd.choices(range(100), k=30))] + [("a", "none", None, 5), ("a", "open", 3, None)]
    pages = [(c, p) for c in "abc" for p in range(0, 140)]
    got = dm.page_to_document(spark.createDataFrame(pages, "case_id string, page int"), spark.createDataFrame(docs, "case_id string, num string, first_page int, last_page int"), carry=("num",)).collect()
    for r in got:
        holding = sorted((f, n) for c, n, f, e in docs if c == r.case_id and f is not None and e is not None and f <= r.page <= e)
        assert r.num == (holding[0][1] if holding else None), (r, holding)
    assert len(got) == len(pages)


def test_event_numbers_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ev, "PAGE_BLOCK", 4)
    rows = [("a" if p % 3 else "b", p, f"p{u}", "page_text", f"e{p}-{u}", "Mandado de citação em 01/02/2024") for p in range(40) for u in range(2)]
    got = ev.extract_events(spark.createDataFrame(rows, "case_id string, page int, unit_id string, unit_type string, evidence_id string, text string")).collect()
    for case in "ab":
        mine = sorted((r.page, r.unit_id, r.raw_event_id) for r in got if r.case_id == case)
        assert [x[2] for x in mine] == [f"raw-{i:06d}" for i in range(1, len(mine) + 1)]


def test_numbers_outgrow_their_digits(spark):
    got = spark.range(1).select(ev.padded("raw-", F.lit(1_234_567), 6).alias("a"), ev.padded("radar-", F.lit(7), 4).alias("b")).first()
    assert (got.a, got.b) == ("raw-1234567", "radar-0007")


def test_search_sends_few_hits_on(spark):
    """Each task ranks its own hits and sends k on; nothing gathers a query's hits."""
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(["red", "green", "blue", "x"], k=9)) if i % 11 else "red green blue") for i in range(400)], "doc_id long, text string")
    q = spark.createDataFrame([("a", "red green"), ("b", "red zzz"), ("c", "zzz"), ("d", "x")], "query_id string, query string")
    hits = se.bm25(q, docs, 5)
    p = plan(hits)
    limits = [x for x in p.split("\n") if "WindowGroupLimit" in x]
    assert any("Partial" in x for x in limits) and any("Final" in x for x in limits), p
    got = {(r.query_id, r.rank): r for r in hits.collect()}
    assert {k[0] for k in got} == {"a", "b", "d"} and all(got["a", i]["mode"] == "and" and got["b", i]["mode"] == "or" for i in range(1, 6))
    every = se.bm25(q, docs, 400).collect()
    for r in every:
        if r.rank <= 5:
            assert got[r.query_id, r.rank].doc_id == r.doc_id
    assert len(got) == 15


def test_snippets_in_the_jvm(spark):
    """Against a plain loop over tokens."""
    import re

    from evidentia.functions.text import python_fold

    word = re.compile(r"[^\W_]+")
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["Ação", "acao", "_b_", "c,", "d-e", "\n", "Éf", "zz"], k=rnd.choice([0, 1, 5, 30, 200]))) for _ in range(60)] + ["", "  ..  ", "«!", "a" * 500]
    queries = {"q1": "acao ef", "q2": "d zz nada", "q3": "!!"}

    def brute(doc, query):
        want, spans = set(word.findall(python_fold(query))), list(word.finditer(doc))
        fold = [python_fold(m.group()) for m in spans]
        if not spans:
            return doc[:200]
        at = [i for i, x in enumerate(fold) if x in want] or [0]
        first = max(at, key=lambda i: (len(set(fold[i : i + 24]) & want), -i))
        first = max(0, min(first, len(spans) - 24))
        last, out = min(len(spans), first + 24), "… " if first else doc[: spans[0].start()]
        for k in range(first, last):
            out += f"«{spans[k].group()}»" if fold[k] in want else spans[k].group()
            out += doc[spans[k].end() : spans[k + 1].start() if k + 1 < len(spans) else None] if k + 1 < last or last == len(spans) else " … "
        return out

    units = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(x, i) for x in queries for i in [*range(len(texts)), 99]], "query_id string, doc_id long")
    got = se.snippets(hits, spark.createDataFrame(list(queries.items()), "query_id string, query string"), units)
    assert "Python" not in plan(got) and "Arrow" not in plan(got)
    for r in got.collect():
        assert r.snippet == (None if r.doc_id == 99 else brute(texts[r.doc_id], queries[r.query_id])), r
