"""Line templates against their SQL and by example; lists of keys against sums."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import block_lists, line_templates, substring_dedup

from tests_llm_helpers import corpus

SCHEMA = "doc_id long, text string, source string"


def by_sql(rows):
    c = duckdb.connect()
    c.register("t0", pa.Table.from_pylist([{"doc_id": r[0], "text": r[1]} for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())])))
    return c.execute("WITH " + line_templates.LINES_SQL.replace("{docs}", "t0") + " SELECT doc_id, n_lines, n_dropped, n_words, n_words_dropped, kept_text FROM line_dedup").fetchall()


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    return {r.doc_id: r.kept_text for r in line_templates.drop_recurring_lines(df, block_bytes=3000).collect()}


def test_equal_sql(spark):
    rnd = random.Random(8)
    rows = corpus()
    for i in range(200, 240):
        head, foot = "Page %d of %d printed on paper" % (i, rnd.randint(1, 9)), "Error code %d at line %d in module alpha" % (i, i * 3)
        by = "this page was written by %s on a day" % "abcdefgh"[i % 8]
        rows.append((i, "\n".join(rnd.sample([head, "own text " + "z%d" % i, foot, by, "other w%d x y z" % (i % 7), "", "fixed boiler line here", "<*> a b"], 6)), "s"))
    rows += [(300, rows[-3][1], "s"), (300, rows[-3][1], "s"), (None, rows[-4][1], "s"), (None, rows[-4][1], "s"), (301, "\r\n \n", "s")]
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], SCHEMA).selectExpr("*", "'x' AS n_lines", "1 AS block")
    out = line_templates.drop_recurring_lines(df, block_bytes=3000)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.n_words, r.n_words_dropped, r.kept_text) for r in out.collect())
    want = by_sql(rows)
    assert got == sorted((str(a), *b) for a, *b in want) and sum(x[2] for x in got) > 100
    assert set(out.columns) == {"doc_id", "text", "source", "block", *line_templates.MADE}
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


def own(i, n=6):
    return " ".join("own%s%s" % (chr(97 + i % 26), "".join(chr(97 + (i * 7 + j * 3 + i // 26) % 26) for _ in range(j + 2))) for j in range(n))


def test_a_repeated_block_goes_as_a_whole(spark):
    block = "\n".join("notice line %s of the block" % x for x in ("one", "two", "three", "four", "five"))
    rows = [(i, own(i) + "\n" + block + "\n" + own(i + 1000)) for i in range(60)]
    assert kept(spark, rows) == {i: own(i) + "\n" + own(i + 1000) for i in range(60)}


def test_one_document_and_its_copies_count_once(spark):
    alone = "\n".join(["the same sentence stands here often"] * 8)
    rows = [(1, alone)] + [(i, own(3) + "\na text that was copied whole") for i in range(2, 40)]
    assert kept(spark, rows) == dict(rows)


def test_common_lines_of_one_leaf(spark):
    """Equally common lines of one leaf, and many other lines in it."""
    common = ["This is the %s of all things" % x for x in ("end", "sum", "head", "last")]
    rows = [(i, own(i) + "\n" + common[i % 4]) for i in range(40)]
    rows += [(100 + i, "This is the " + own(i, 4)) for i in range(300)]
    got = kept(spark, rows)
    assert all(got[i] == own(i) for i in range(40)) and all(got[100 + i] == "This is the " + own(i, 4) for i in range(300))


FIELDS = [
    "This article was posted by {a} in the category {b} and read many times",
    "Posted by user {a}",
    "Posted by user {a} today again",
    "{a} liked this article and shared it with friends",
    "The following long notice was written by {a} {b} {c} for the readers of all these pages",
    "the report was sent by {a} to the office",
    "In {a} the weather will be {b} on most of the coming days",
]


@pytest.mark.parametrize("values", [0, 10, 4])
def test_fields_wherever_they_stand(spark, values):
    """Values of fields that are all different, or some of which are frequent."""
    name = lambda i, k: own(i * 3 + k if not values else (i * (k + 1) + i // 7) % values + 40 * k, 1)
    rows = [(i, own(i) + "\n" + "\n".join(x.format(a=name(i, 0), b=name(i, 1), c=name(i, 2)) for x in FIELDS) + "\n" + own(i + 900, 9)) for i in range(60)]
    assert kept(spark, rows) == {i: own(i) + "\n" + own(i + 900, 9) for i in range(60)}


def test_recall_and_precision_of_planted_templates(spark):
    """Templates with one to three fields at any places among lines of a small
    vocabulary; each is in 12 documents."""
    rnd = random.Random(4)
    vocab = ["v" + "abcdefghijklmnopqrst"[i % 20] * (1 + i // 20) for i in range(300)]
    plants = []
    for _ in range(40):
        n = rnd.randint(7, 20)
        fields = rnd.sample(range(n), rnd.randint(1, min(3, 3 * n // 10)))
        plants.append([None if i in fields else rnd.choice(vocab) for i in range(n)])
    docs, planted, clean = [[] for _ in range(160)], 0, 0
    for p in plants:
        for d in rnd.sample(range(160), 12):
            docs[d].append(" ".join(w or rnd.choice(vocab) for w in p))
            planted += 1
    marked = [set(d) for d in docs]
    for d in docs:
        for _ in range(8):
            d.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(4, 20))))
            clean += 1
    got = kept(spark, [(i, "\n".join(d)) for i, d in enumerate(docs)])
    left = [set(got[i].split("\n")) for i in range(160)]
    missed = sum(len(m & x) for m, x in zip(marked, left))
    wrong = sum(x not in left[i] for i, d in enumerate(docs) for x in d if x not in marked[i])
    assert missed <= planted // 10 and wrong <= clean // 100


def test_short_lines(spark):
    openings = [(i, own(i) + "\nI do not %s %s" % (own(i, 1), own(i + 30, 1))) for i in range(10)]
    exact = [(100 + i, "All rights reserved.\n" + own(i)) for i in range(5)]
    rare = [(200 + i, "Some rights reserved.\n" + own(i)) for i in range(4)]
    numbers = [(300 + i, "%d\n" % i + own(i)) for i in range(9)]
    got = kept(spark, openings + exact + rare + numbers)
    assert all(got[i] == t for i, t in openings + rare + numbers) and all(got[100 + i] == own(i) for i in range(5))


def test_a_field_of_any_value(spark):
    line = "the report was sent by %s to the office"
    rows = [(i, own(i) + "\n" + line % own(i, 1)) for i in range(6)]
    assert kept(spark, rows) == {i: own(i) for i in range(6)}


# ---------------------------------------------------------------- lists


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=60))
def test_numbers_round_trip(keys, numbers):
    keys = np.unique(np.array(keys, np.uint64))
    assert (block_lists.undeltas(block_lists.deltas(keys)) == keys).all()
    for x in (numbers, [v % 2 for v in numbers], [7 + v % 16 for v in numbers]):
        assert block_lists.un_small_numbers(block_lists.small_numbers(np.array(x))).tolist() == x


@pytest.mark.parametrize("n_slices", [1, 16, 4096])
def test_counts_in_one_and_two_levels(spark, n_slices):
    rng = np.random.default_rng(n_slices)
    pool = rng.integers(0, 2**40, 500, dtype=np.uint64)
    blocks = {b: block_lists.sorted_counts(rng.choice(pool, 200), rng.integers(0, 3, 200)) for b in (0, 5, 1023, 1024, 3000, 3001)}
    total = Counter()
    for u, n in blocks.values():
        total.update(dict(zip(u.tolist(), n.tolist())))
    sent = spark.createDataFrame(pa.concat_tables(block_lists.lists_of([(b, "x", u, n)], 40, n_slices) for b, (u, n) in blocks.items()))
    got = block_lists.count_answers(sent, 40, n_slices, lambda n: np.minimum(n, 9)).toArrow()
    for b, (u, _) in blocks.items():
        mine = got.filter(pa.compute.equal(got["block"], b))
        assert block_lists.answers(mine, "x").tolist() == [min(9, total[k]) for k in u.tolist()]


@pytest.mark.parametrize("n_slices", [1, 4096])
def test_places_in_one_and_two_levels(spark, n_slices):
    rng = np.random.default_rng(3)
    lists, first = {}, {}
    for b in (0, 7, 2000, 2001, 9000):
        h = np.sort(rng.choice(np.arange(1, 400, dtype=np.uint64) << np.uint64(54), 120, replace=False))
        doc, start = rng.integers(0, 30, 120).astype(np.uint64), rng.integers(0, 5, 120).astype(np.uint64)
        lists[b] = (h, doc, start)
        for x in zip(h.tolist(), doc.tolist(), start.tolist()):
            first[x[0]] = min(first.get(x[0], x[1:]), x[1:])
    rows = [r for b, (h, doc, start) in lists.items() for r in substring_dedup._place_lists(b, min(n_slices, 1024), h, h ^ np.uint64(9), doc, start)]
    rows += [(b, -1 - b, "own", b"%d" % b, b"") for b in lists]
    got = substring_dedup._merge_candidates(spark.createDataFrame(block_lists.list_table(rows)), n_slices).toArrow()
    for b, cols in lists.items():
        mine = got.filter(pa.compute.equal(got["block"], b))
        assert mine.filter(pa.compute.equal(mine["kind"], "own"))["payload"].to_pylist() == [b"%d" % b]
        assert block_lists.answers(mine, "exact").tolist() == [int(first[h] != (d, s)) for h, d, s in zip(*(c.tolist() for c in cols))]


def test_packing_in_few_tasks(spark, monkeypatch):
    """The same sequences, whatever the number of tasks that evolve the islands."""
    from evidentia.llm import packing

    rows = spark.range(300).selectExpr("id", "cast(1 + (id * 7919) % 900 AS long) AS length")
    found = []
    for most in (20_000, 1):
        monkeypatch.setattr(packing, "MOST_TASKS", most)
        found.append(sorted((r.id, r.sequence_id, r.offset) for r in packing.pack(rows, 1000, block_rows=32).collect()))
    assert found[0] == found[1]


def test_leaves_are_handed_on(monkeypatch):
    """Lines take the leaves that the step before found for them, in any order
    of rows, without their paths and pairs."""
    Tree = line_templates.Tree
    texts = [f"alpha beta gamma delta x{i}y eps zeta\nq{'abcde'[i % 5]} beta gamma delta more of it\n{' '.join(chr(97 + i) + w for w in 'pqrstu')}" for i in range(9)]
    tree = Tree(pa.array(texts), 3)
    keys = tree.paths()
    pairs, line = tree.pairs()
    count = lambda k: np.where((n := np.unique(k, return_inverse=True, return_counts=True))[2][n[1]].reshape(k.shape) >= 5, 5, 0) * (k > 0)
    tree.take_leaves(keys, count(keys), np.bincount(line, count(pairs) > 0, len(tree.n)).astype(np.int64))
    raw = tree.leaves()
    assert tree.fits.any() and not tree.fits.all() and 0 < len(raw) // 17 < tree.fits.sum()
    monkeypatch.setattr(Tree, "paths", None)
    monkeypatch.setattr(Tree, "pairs", None)
    for order in (list(range(9)), list(range(8, -1, -1))):
        other = Tree(pa.array([texts[i] for i in order]), 3)
        other.put_leaves(raw)
        whole = np.ones(len(other.tail[0]), np.int64)
        assert sorted(other.supports().tolist()) == sorted(tree.supports().tolist())
        assert sorted(other.templates(whole)[0].tolist()) == sorted(tree.templates(whole)[0].tolist())
    none = Tree(pa.array(["", None, "a b"]), 3)
    none.put_leaves(b"")
    assert not none.fits.any() and len(none.templates(np.zeros(0, np.int64))[0]) == 0


@pytest.mark.parametrize("coarse", [10, 0])
def test_rows_pass_through_the_counts(spark, monkeypatch, coarse):
    bl = block_lists
    monkeypatch.setattr(bl, "COARSE_BITS", coarse)
    keys = np.array([3, 1 << 62, 3 << 62], np.uint64)
    made = [r for b in (0, 1) for r in bl.lists_of([(b, "k", keys, np.array([1, 2, 3]))], 64, 4).to_pylist()]
    made += [{"block": b, "slice": b, "kind": "own", "payload": bytes([b]), "extra": b""} for b in (0, 1)]
    sent = spark.createDataFrame([tuple(r[c] for c in ("block", "slice", "kind", "payload", "extra")) for r in made], bl.LIST)
    got = bl.count_answers(sent, 64, 4, lambda n: n, "", "own").collect()
    assert sorted((r.block, bytes(r.payload)) for r in got if r.kind == "own") == [(0, b"\0"), (1, b"\1")]
    for b in (0, 1):
        parts = sorted((r.slice, bytes(r.payload)) for r in got if r.kind == "k" and r.block == b)
        assert np.concatenate([bl.un_small_numbers(p) for _, p in parts]).tolist() == [2, 4, 6]
