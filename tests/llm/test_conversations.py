"""Repair and trie of conversations against brute-force versions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from evidentia.llm import earley, prefix_trie, role_repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed=4, n=90):
    """Shared openings, copies, gaps, nulls in every column, long ones, odd roles, repeated rows."""
    rnd, rows = random.Random(seed), []
    say = ["Hi there.", "What is it?", "It is so!", "no end", " ", "", "Ünï \x0b.", "a\nb.", "Yes. ", "same"]
    for c in range(n):
        if c % 20 == 3 and c > 20:
            continue
        size = 40 if c == 7 else 0 if c % 11 == 5 else rnd.randint(1, 7)
        for t in range(size):
            role = ("system" if t == 0 and c % 3 == 0 else "user" if t % 2 == 0 else "assistant") if rnd.random() < 0.8 else rnd.choice(["user", "assistant", "tool", "", None, "system", "Úser"])
            text = say[(t + c % 3) % 4] if c % 4 == 0 else rnd.choice([*say, None, "unique %d." % rnd.randint(0, 9999)])
            rows.append((c, t * (2 if c % 9 == 1 else 1) if rnd.random() < 0.95 else None, role, text))
            if rnd.random() < 0.05:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "Null id."), (None, 2, "assistant", "Yes."), (-21, 0, "user", "Below zero."), (-20, 0, "user", "Base."), (-20, 1, None, None)]
    return rows


def cheapest(symbols):
    """All edits by cost and then audit, without a chart."""
    heap, seen = [(0, "", 0, "B")], set()
    while heap:
        c, a, i, q = heapq.heappop(heap)
        if i == len(symbols) and q in "BA":
            return c, a
        if (i, q) in seen:  # the first to get here has the least cost, and of equal costs the least audit
            continue
        seen.add((i, q))
        to = "A" if q == "U" else "U"
        heapq.heappush(heap, (c + 5, a + "I", i, to))
        if i < len(symbols):
            s = symbols[i]
            heapq.heappush(heap, (c + 2, a + "D", i + 1, q))
            if s != "x":
                t = 5 if s.isupper() or s == "!" else 0
                heapq.heappush(heap, (c + t + 1, a + "R", i + 1, to))
                if s.lower() == "s" and q == "B":
                    heapq.heappush(heap, (c + t, a + "K", i + 1, "S"))
                if s.lower() == {"U": "u", "A": "a"}[to]:
                    heapq.heappush(heap, (c + t, a + "K", i + 1, to))


def brute_repair(rows):
    convs = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        role, text = say(role), say(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, syms, n = set(), "", [0, 0, 0]
        for _, role, text in turns:
            letters = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not letters else 1 if (role, text) in seen else 2 if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            s = role[:1] if role[:1] in tuple("sua") else "."
            syms += "x" if fault in (0, 1) else ({".": "!"}.get(s, s.upper()) if fault == 2 else s)
        ts = [t for t, _, _ in turns if t is not None]
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(syms)
        made, i, want = [], 0, "user"
        for x in audit:
            if x == "I":
                made.append(f"{want}:")
            elif x != "D":
                made.append(f"{turns[i][1] if x == 'K' else want}:{turns[i][2]}")
            i += x != "I"
            if x in "IR" or x == "K" and turns[i - 1][1][:1] != "s":
                want = "assistant" if want == "user" else "user"
        out[c] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    for c in convs:
        convs[c] = [x[1:] for x in sorted(convs[c], key=lambda x: (x[0] is not None, x[0] or 0))]
    whole = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(convs.get(base, [])[:h] + convs[c][h:])
    nodes = {}
    for c, w in whole.items():
        for d in range(len(w) + 1):
            nodes.setdefault(w[:d], []).append(c)
    out = {}
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(k))
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes) for x in below)
        saved = sum((len(nodes[x]) - 1) * (len(WORD.findall(x[-1][1])) if x else 0) for x in below)
        out[min(members), len(k)] = (min(nodes[k[:-1]]) if k else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_repairs(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_parser_against_search():
    rnd = random.Random(1)
    for _ in range(600):
        s = "".join(rnd.choice("suaua.xSUA!") for _ in range(rnd.randint(0, 12)))
        assert earley.accepted(earley.parse(s)) == cheapest(s), s
        cuts = sorted(rnd.randint(0, len(s)) for _ in range(3))
        parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)])]
        cost, own = role_repair.chain([{e: earley.parse(p, e) for e in (earley.STATES if i else ["Begin"])} for i, p in enumerate(parts)])
        assert (cost, "".join(a for _, a in own)) == cheapest(s), (s, parts)


@pytest.mark.parametrize("part", [2048, 3])
def test_repairs(spark, part):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_repair(rows)
    got = as_repairs(role_repair.repair(role_repair.damage(df), part_turns=part))
    none = (0,) * 6 + ("", role_repair.NOTHING)
    assert {c: got.get(c, none) for c in want} == want and set(got) <= set(want)


def test_parts_by_bytes(spark):
    rows = talks(8, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_repairs(role_repair.repair(role_repair.damage(df), part_bytes=30))
    assert all(brute_repair(rows)[c] == v for c, v in got.items())


def distinct_places(rows):
    """Without rows that share a turn but differ: their order is the hashes'."""
    kept = {}
    for r in rows:
        kept.setdefault(r[:2], r)
    return list(kept.values())


def test_trie(spark, tmp_path):
    rows = distinct_places([r for r in talks(5, 130) if r[1] is not None])
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "TEXT").selectExpr("*", "'x' AS k1", "1 AS N_CONVS").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.op13_prefix_trie(spark, str(tmp_path)).collect()}
    assert got == brute_trie(rows)


def test_trie_in_small_blocks(spark, tmp_path, monkeypatch):
    """Many shards, several rounds of merging, chunks of ends and blocks of turns."""
    monkeypatch.setattr(prefix_trie, "SHARD_CONVS", 1)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    same = [(1000 + c, t, "user", f"turn {t} of all.") for c in range(40) for t in range(5)]
    rows = distinct_places([r for r in talks(6, 60) if r[1] is not None]) + same
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.op13_prefix_trie(spark, str(tmp_path)).collect()}
    assert got == brute_trie(rows)


def test_ties_and_repeated_rows(spark):
    """Rows of one turn have one order whatever the table's; null turns are first."""
    rows = [(1, 5, "user", "B."), (1, None, "user", "x."), (1, 5, "user", "A."), (1, 5, "user", "A."), (1, None, "assistant", "y.")]
    seen = {tuple((r.pos, r.h1) for r in prefix_trie.turns_of(spark.createDataFrame(rows[i:] + rows[:i], SCHEMA)).orderBy("pos").collect()) for i in range(3)}
    assert len(seen) == 1 and [p for p, _ in seen.pop()] == [0, 1, 2, 3, 4]


def test_very_long_texts(spark, tmp_path):
    rows = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "é" * 1_000_000), (2, 0, "user", "word " * 400_000 + "end.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert as_repairs(role_repair.op12_role_repair(spark, str(tmp_path))) == brute_repair(rows)
    assert {(r.conv_id, r.depth): r.saved_tokens for r in prefix_trie.op13_prefix_trie(spark, str(tmp_path)).collect()} == {k: v[4] for k, v in brute_trie(rows).items()}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert role_repair.op12_role_repair(spark, str(tmp_path)).count() == 0 == prefix_trie.op13_prefix_trie(spark, str(tmp_path)).count()
