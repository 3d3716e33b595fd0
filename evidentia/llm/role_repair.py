"""Repair of conversations' structure by error-correcting Earley parsing.

Turns become symbols: a role's initial and the turn's first fault.  Each
conversation's symbols are parsed by the weighted grammar of ``earley``, and the
cheapest edits give the repaired turns.  A conversation is cut into parts of a
bounded number of turns and bytes.  One part is repaired where it stands; of
several, each is parsed from every state that can hold before it, the parts'
tables are chained, and each part is then repaired from the state it begins in.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.running import running, safe_join

from .earley import ACCEPTED, STATES, accepted, edits, transfers
from .spark_util import cut

#: Turns and bytes of text of one part; turn numbers of one block of the order.
PART_TURNS, PART_BYTES, BLOCK = 2048, 16 << 20, 1024
#: Fixed values of the contract: blank, and truncated.
BLANK_RE, ENDED_RE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
LEGAL = ("su", "ua", "au")
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage of crc32(``conv_id:turn``)
    % 20: 0 drops the row, 1 empties its text, 2 takes its sentence marks, 3
    repeats it, 4 makes it the user's.  Null roles and texts, and null numbers in
    the hashed string, are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def in_parts(rows: DataFrame, part_turns: int = PART_TURNS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with pos (from 0 in the
    conversation), part (a number that rises with pos), h1, h2 (of role and
    text), blank and open (no sentence mark at the end).

    In order of turn, nulls first; rows of one turn by role and text, so that
    repeated ones are neighbours."""
    r = rows.withColumns({
        "turn": F.col("turn").cast("long"), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(13), "text", "role"),
        "blank": ~F.regexp_like("text", F.lit(BLANK_RE)), "open": ~F.regexp_like("text", F.lit(ENDED_RE)),
    })
    b = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)).cast("long"))
    r = r.withColumn("_b", b)
    size = (F.octet_length("text") + F.octet_length("role")).cast("long")
    r = running(r, ["conv_id"], ["_b"], [F.col("turn").asc_nulls_first(), "role", "text"], {"_n": (F.lit(1).cast("long"), "sum"), "_bytes": (size, "sum")})
    pos = F.col("_n") - 1
    part = F.floor(pos / part_turns) + F.floor(F.col("_bytes") / part_bytes)
    return r.select("conv_id", "turn", "role", "text", pos.alias("pos"), part.cast("long").alias("part"), "h1", "h2", "blank", "open")


def symbol(role: str, must_go: bool, is_open: bool) -> str:
    if must_go:
        return "x"
    c = role[:1] if role[:1] in ("s", "u", "a") else "."
    return (c.upper() if c != "." else "!") if is_open else c


def n_illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def line(what: str, role: str, text: str) -> str:
    return f"{role}:{text}" if what == "k" else {"u": f"user:{text}", "a": f"assistant:{text}", "U": "user:", "A": "assistant:"}[what]


def lines_of(symbols: str, audit: str, entry: str, roles: list[str], texts: list[str]) -> list[str]:
    return [line(w, roles[i] if i < len(roles) else "", texts[i] if i < len(texts) else "") for i, w in edits(symbols, audit, entry)]


def part_rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows of one (conv_id, part), from batches sorted by them."""
    key, rows = None, {c: [] for c in columns}
    for b in batches:
        got = [b.column(c).to_pylist() for c in ("conv_id", "part", *columns)]
        for conv, part, *values in zip(*got):
            if (conv, part) != key:
                if key is not None:
                    yield key, rows
                key, rows = (conv, part), {c: [] for c in columns}
            for c, v in zip(columns, values):
                rows[c].append(v)
    if key is not None:
        yield key, rows


def repair_first(parts: DataFrame) -> DataFrame:
    """(conv_id, part, result): the first part of each conversation repaired as
    if it were the only one; of later parts their numbers alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    cols = ["turn", "role", "text", "blank", "open"]
    schema = T.StructType([parts.schema["conv_id"], *T._parse_datatype_string(f"part long, {RESULT}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, part), r in part_rows(batches, cols):
            row = {"conv_id": conv, "part": part}
            if part == 0:
                seen, symbols, n_blank, n_dup, n_open = set(), [], 0, 0, 0
                for role, text, blank, is_open in zip(r["role"], r["text"], r["blank"], r["open"]):
                    again = (role, text) in seen
                    seen.add((role, text))
                    n_blank += blank
                    n_dup += again and not blank
                    n_open += is_open and not blank and not again
                    symbols.append(symbol(role, blank or again, is_open))
                cost, audit = accepted(transfers("".join(symbols)))
                turns = [t for t in r["turn"] if t is not None]
                text = "\n".join(lines_of("".join(symbols), audit, "Begin", r["role"], r["text"]))
                row |= {
                    "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": n_blank, "duplicate": n_dup, "truncated": n_open,
                    "illegal": n_illegal([x[:1] for x in r["role"]]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
                }
            out.append(row)
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    inside = parts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return inside.select("conv_id", "part", *cols).mapInArrow(run, schema)


# ---------------------------------------------------------------- conversations of several parts


def narrow_faults(parts: DataFrame) -> DataFrame:
    """(conv_id, part, pos, turn, initial, fault) of ``parts``: a row is a
    duplicate if its role and text stand at an earlier place, which is asked of
    the least place of each, not of the conversation as a whole."""
    n = cut(parts.select("conv_id", "part", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "h1", "h2", "blank", "open"))
    first = n.groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("_first"))
    x = safe_join(n, first, ["conv_id", "h1", "h2"])
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(F.col("open"), "truncated").otherwise("none")
    return x.select("conv_id", "part", "pos", "turn", "initial", fault.alias("fault"))


def symbol_runs(faults: DataFrame) -> DataFrame:
    """(conv_id, part, symbols, initials): strings of one part's turns."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(".")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.when(known == ".", "!").otherwise(F.upper(known))).otherwise(known)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.col("_l")), lambda s: s[c]), "")
    g = faults.groupBy("conv_id", "part").agg(F.collect_list(F.struct("pos", sign.alias("s"), known.alias("i"))).alias("_l"))  # PART_TURNS rows at most
    return g.select("conv_id", "part", joined("s").alias("symbols"), joined("i").alias("initials"))


def with_transfers(runs: DataFrame) -> DataFrame:
    """``runs`` with ``ways``: array of (entry, exit, cost, audit)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*runs.schema, *T._parse_datatype_string("ways array<struct<entry:string,exit:string,cost:long,audit:string>>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                entries = STATES if row["part"] else ("Begin",)
                row["ways"] = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in entries for x, (c, a) in transfers(row["symbols"], e).items()]
                yield pa.RecordBatch.from_pylist([row], arrow)

    return runs.mapInArrow(run, schema)


def chain(tables: list[dict[str, dict[str, tuple[int, str]]]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost, and (entry state, audit) of each part, of the least (cost, audit)
    through parts' tables {entry: {exit: (cost, audit)}}.

    What all states' audits begin with is settled and put away, so that mostly
    a short rest is compared."""
    alive: dict[str, tuple[int, str, tuple]] = {"Begin": (0, "", ())}
    for table in tables:
        now: dict[str, tuple[int, str, tuple]] = {}
        for entry, (c, a, path) in alive.items():
            for leave, (c2, a2) in table.get(entry, {}).items():
                v = (c + c2, a + a2)
                if leave not in now or v < now[leave][:2]:
                    now[leave] = (*v, (path, entry, a2))
        n = len(os.path.commonprefix([a for _, a, _ in now.values()]))
        alive = {s: (c, a[n:], p) for s, (c, a, p) in now.items()}
    cost, _, path = min((alive[s] for s in ACCEPTED if s in alive), key=lambda v: v[:2])
    out = []
    while path:
        path, entry, audit = path
        out.append((entry, audit))
    return cost, out[::-1]


def chained(tables: DataFrame) -> DataFrame:
    """(conv_id, part, symbols, entry, audit, cost): each part's own edits in
    the cheapest repair of its whole conversation.  A group is the parts of one
    conversation: 16 audits for every ``PART_TURNS`` turns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([tables.schema["conv_id"], *T._parse_datatype_string("part long, symbols string, entry string, audit string, cost long").fields])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        maps = []
        for r in rows:
            m: dict[str, dict[str, tuple[int, str]]] = {}
            for w in r["ways"]:
                m.setdefault(w["entry"], {})[w["exit"]] = (w["cost"], w["audit"])
            maps.append(m)
        cost, own = chain(maps)
        return pa.Table.from_pylist([{"conv_id": r["conv_id"], "part": r["part"], "symbols": r["symbols"], "entry": e, "audit": a, "cost": cost} for r, (e, a) in zip(rows, own)], arrow)

    return tables.groupBy("conv_id").applyInArrow(run, schema)


def repair_long(parts: DataFrame) -> DataFrame:
    """(conv_id, result) of conversations of several parts."""
    faults = cut(narrow_faults(parts))
    runs = cut(with_transfers(symbol_runs(faults)))
    own = cut(chained(runs))
    by_turn = faults.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    counts = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated"))
    )
    # neighbours inside a part, and the last of a part with the first of the next
    bad = lambda i: F.size(F.filter(F.sequence(F.lit(1), F.length(i) - 1), lambda k: ~F.substring(i, k, F.lit(2)).isin(*LEGAL)))
    pairs = runs.groupBy("conv_id").agg(
        F.sum(F.when(F.length("initials") > 1, bad(F.col("initials"))).otherwise(0)).alias("_in"),
        F.array_sort(F.collect_list(F.struct("part", F.substring("initials", 1, 1).alias("f"), F.expr("right(initials, 1)").alias("l")))).alias("_e"),
    )
    across = F.size(F.filter(F.zip_with(F.slice("_e", F.lit(1), F.size("_e") - 1), F.slice("_e", F.lit(2), F.size("_e") - 1), lambda a, b: F.concat(a["l"], b["f"])), lambda p: ~p.isin(*LEGAL)))
    pairs = pairs.select("conv_id", (F.col("_in") + across).cast("long").alias("illegal"))
    audits = own.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    out = safe_join(safe_join(safe_join(counts, pairs, ["conv_id"]), audits, ["conv_id"]), digests(repaired_parts(parts, own)), ["conv_id"])
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(NOTHING)))


def repaired_parts(parts: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, part, lines): the repaired turns of each part that has any."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([parts.schema["conv_id"], *T._parse_datatype_string("part long, lines string").fields])
    arrow = to_arrow_schema(schema)
    cols = ["role", "text", "symbols", "entry", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, part), r in part_rows(batches, cols):
            # what belongs to the part stands beside its first turn
            made = lines_of(r["symbols"][0], r["audit"][0], r["entry"][0], r["role"], r["text"])
            if made:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "lines": "\n".join(made)}], arrow)

    first = parts.groupBy("conv_id", "part").agg(F.min("pos").alias("pos"))
    beside = safe_join(safe_join(parts, safe_join(first, own.drop("cost"), ["conv_id", "part"]), ["conv_id", "part", "pos"]), own.select("conv_id", "part"), ["conv_id", "part"])
    inside = beside.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return inside.select("conv_id", "part", *cols).mapInArrow(run, schema)


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): parts go through the hash one after the
    other; no more than one is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([lines.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, began = None, None, False
        row = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], arrow)
        for b in batches:
            for c, x in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
                if not began or c != conv:
                    if began:
                        yield row()
                    conv, sha, began = c, hashlib.sha256(), True
                else:
                    sha.update(b"\n")
                sha.update(x.encode())
        if began:
            yield row()

    inside = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "lines")
    return inside.mapInArrow(run, schema)


def repair(rows: DataFrame, part_turns: int = PART_TURNS, part_bytes: int = PART_BYTES) -> DataFrame:
    """rows (conv_id, turn, role, text; no null role or text): a row for each
    conv_id with gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.

    Rows of one turn go by role and text; a null conv_id is one conversation.  A
    repair without turns has the hash of nothing.  Repaired turns come from
    ``repaired_parts``.
    """
    parts = in_parts(rows, part_turns, part_bytes)
    first = cut(repair_first(parts))
    more = first.filter("part > 0").select("conv_id").distinct()
    single = first.filter("part = 0").drop("part")
    if more.isEmpty():
        return single
    some = more.withColumn("_more", F.lit(True))
    kept = safe_join(single, some, ["conv_id"]).filter("_more IS NULL").drop("_more")
    long = cut(safe_join(parts, some, ["conv_id"], "inner").drop("_more"))
    return kept.unionByName(repair_long(long))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as ``damage`` says and repaired; a
    conversation that has no row left has zeros, an empty audit and the hash of
    nothing.  A null conv_id is one conversation; other columns aren't read."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair(damage(rows))
    out = safe_join(rows.select("conv_id").distinct(), done, ["conv_id"])
    zero = F.lit(0).cast("long")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


def _sql() -> str:
    """The repair as DuckDB SQL: a fold over a conversation's symbols that keeps
    the least of each of the four states as a string, cost first, and a fold
    over the audit's letters that writes the repaired turns."""
    from .prefix_trie import CRC32

    state = lambda k: f"string_split(acc, '|')[{k}]"  # noqa: E731  1 Begin, 2 AfterSystem, 3 AfterUser, 4 AfterPair
    add = lambda v, c, x: f"CASE WHEN {v} = '~' THEN '~' ELSE lpad((left({v}, 9)::BIGINT + ({c}))::VARCHAR, 9, '0') || substr({v}, 10) || '{x}' END"  # noqa: E731  '~' is above all
    late = "(CASE WHEN ascii(x) BETWEEN 65 AND 90 OR x = '!' THEN 5 ELSE 0 END)"
    if_ = lambda cond, v: f"CASE WHEN {cond} THEN {v} ELSE '~' END"
    put_u = f"least({state(3)}, {add(state(1), '5', 'I')}, {add(state(2), '5', 'I')}, {add(state(4), '5', 'I')})"
    user = lambda k: f"least({if_("x <> 'x'", add(state(k), f'1 + {late}', 'R'))}, {if_("lower(x) = 'u'", add(state(k), late, 'K'))})"
    step = (
        f"concat_ws('|', {add(state(1), '2', 'D')}, least({add(state(2), '2', 'D')}, {if_("lower(x) = 's'", add(state(1), late, 'K'))}), "
        f"least({add(state(3), '2', 'D')}, {user(1)}, {user(2)}, {user(4)}), "
        f"least({add(state(4), '2', 'D')}, {if_("x <> 'x'", add(state(3), f'1 + {late}', 'R'))}, {if_("lower(x) = 'a'", add(state(3), late, 'K'))}))"
    )
    return f"""
WITH damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(s="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations)
  WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS pair
  FROM placed),
lists AS (
  SELECT conv_id, list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x'
      WHEN fault = 'truncated' THEN CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN upper(left(role, 1)) ELSE '!' END
      WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '.' END ORDER BY pos) AS syms,
    list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts,
    CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ways AS (
  SELECT *, list_reduce(['000000000|~|~|~'] || flatten(list_transform(syms, lambda y: ['+u', '+a', y])) || ['+u', '+a'], lambda acc, x:
    CASE WHEN x = '+u' THEN concat_ws('|', {state(1)}, {state(2)}, {put_u}, {state(4)})
      WHEN x = '+a' THEN concat_ws('|', {state(1)}, {state(2)}, {state(3)}, least({state(4)}, {add(state(3), '5', 'I')}))
      ELSE {step} END) AS acc
  FROM lists),
best AS (SELECT *, least({state(1)}, {state(4)}) AS way FROM ways),
letters AS (
  SELECT conv_id, k, letter, (sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w)::BIGINT AS i, roles, texts, syms,
    sum(CASE WHEN letter IN ('I', 'R') OR (letter = 'K' AND left(roles[i0], 1) <> 's') THEN 1 ELSE 0 END) OVER w AS made
  FROM (SELECT conv_id, roles, texts, syms, k, substr(way, k + 9, 1) AS letter, (sum(CASE WHEN substr(way, k + 9, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k))::BIGINT AS i0
        FROM (SELECT *, unnest(range(1, strlen(way) - 8)) AS k FROM best))
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
repaired AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN roles[i] ELSE CASE WHEN made % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE texts[i] END, chr(10) ORDER BY k) AS lines
  FROM letters WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(way, 9)::BIGINT, 0) AS cost, coalesce(substr(way, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _sql()
