"""Prefix trie of conversations, from mergeable partial tries.

A conversation is a path from the textless root, a node for each turn; nodes of
several conversations with equal turns up to there are one node.  A node is
named by its depth and two 64-bit hashes of its turns, so that tries merge by
key: each shard of conversations gives a table of its own nodes (members,
smallest member), tables are merged in rounds of ``FAN``, and lists of members
that end in a node are merged in chunks of ids.  The rollup then goes from the
bottom up along each path: a node's figures are held by its smallest member,
summed from the end of that path, and added over the members of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.running import numbered, running

from .spark_util import cut, n_words, salted_join

#: Conversations of one partial trie, tables merged into one in a round, ids of
#: one chunk of an end list, turns of one block of a conversation.
SHARD_CONVS, FAN, CHUNK, BLOCK = 65_536, 16, 4096, 1024
#: Conversations are rebuilt over the first of each run of 20, with 0 to 3 of its turns.
RUN, HEADS = 20, 4
NODE = ("depth", "k1", "k2")
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, h1, h2, words): a row for each turn in order.

    Ordered by turn, null first; rows of one turn by the hashes of role and
    text.  Null roles and texts are empty; rows without a conv_id belong to no
    conversation and are left out.  Only hashes and word counts go on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = cut(
        conversations.filter("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(11), text, role).alias("h2"), n_words(text).alias("words")
        )
    )
    untimed = F.col("turn").isNull()
    # turns without a number are blocks of the hash's first bits: the next in the order
    rows = rows.withColumns({"_b": F.when(~untimed, F.floor(F.col("turn") / BLOCK).cast("long")).otherwise(F.lit(-(1 << 62)).cast("long")), "_s": F.when(untimed, F.shiftright("h1", 52)).otherwise(F.lit(0).cast("long"))})
    out = numbered(rows, ["conv_id"], ["_b", "_s"], [F.col("turn").asc_nulls_first(), "h1", "h2"], "_n")
    return out.select("conv_id", (F.col("_n") - 1).alias("pos"), "h1", "h2", "words")


def rebuilt(turns: DataFrame, run: int = RUN, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth from 1, h1, h2, words, size), and a row of depth 0 for
    each conversation: conversation c is the first h turns of c - c % run (as
    many as there are) and its own after the first h, h = crc32(c) % heads;
    ``size`` is the number of turns."""
    turn = F.struct("pos", "h1", "h2", "words")
    each = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < heads - 1, turn))).alias("first"))
    each = cut(each.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % run}))
    base = each.filter("conv_id = base").select("base", F.col("first").alias("head"))
    none = F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,words:bigint>>")
    plan = each.join(base, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
    k = F.size("head")
    plan = plan.select("conv_id", "h", "head", k.cast("long").alias("k"), (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + k).alias("size"))
    own = turns.join(plan.select("conv_id", "h", "k", "size"), "conv_id").filter(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "h1", "h2", "words", "size")
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(F.lit(-1).cast("long").alias("pos"), zero.alias("h1"), zero.alias("h2"), zero.alias("words")))
    top = plan.select("conv_id", "size", F.explode(F.concat(root, "head")).alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.h1", "t.h2", "t.words", "size")
    return own.unionByName(top)


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, size): the nodes of each path,
    with the parent's hashes.  turns: (conv_id, depth, h1, h2, words, size).

    A node's hashes combine its turns, each hashed with its place."""
    here = F.col("depth") > 0
    term = lambda seed: F.when(here, F.xxhash64("h1", "h2", "depth", F.lit(seed))).otherwise(F.lit(0).cast("long"))
    t = turns.withColumns({"_t1": term(31), "_t2": term(47), "_b": F.floor(F.col("depth") / BLOCK)})
    t = running(t, ["conv_id"], ["_b"], ["depth"], {"k1": (F.col("_t1"), "xor"), "k2": (F.col("_t2"), "xor")})
    parent = lambda k, s: F.col(k).bitwiseXOR(F.col(s))
    return t.select("conv_id", "depth", "k1", "k2", parent("k1", "_t1").alias("p1"), parent("k2", "_t2").alias("p2"), "words", "size")


def partial_tries(paths: DataFrame, shards: int) -> DataFrame:
    """The nodes of each shard's own trie: n_convs, conv_id, parent, words."""
    shard = F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(shards)).cast("int")
    return paths.groupBy(shard.alias("shard"), *NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))


def merge_tries(tries: DataFrame, shards: int) -> DataFrame:
    """One trie: tables are merged ``FAN`` at a time, so that a node of every
    conversation meets few rows in each round."""
    while shards > 1:
        shards = -(-shards // FAN)
        tries = tries.groupBy(F.expr(f"shard div {FAN}").cast("int").alias("shard"), *NODE).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    return tries.drop("shard")


def end_lists(paths: DataFrame) -> DataFrame:
    """(node, chunk, ids): who ends in a node, in numeric order, ``CHUNK`` ids
    at most in a row."""
    last = paths.filter(F.col("depth") == F.col("size"))
    return last.groupBy(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): chunks go through the hash one after the other, so
    a node of any number of ends needs no more memory than a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        out = lambda: pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), x)) for x in done], schema)
        for b in batches:
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key != node:
                    if node is not None:
                        done.append([*node, sha.hexdigest()])
                    node, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids)).encode())
            if done:
                yield out()
                done.clear()
        if node is not None:
            done.append([*node, sha.hexdigest()])
            yield out()

    schema = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
    inside = ends.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return inside.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def with_children(nodes: DataFrame) -> DataFrame:
    """Nodes with ``n_children``."""
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(kids, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_conv_id``; a node of very many children is dealt out."""
    on = ["_d", "p1", "p2"]
    big = nodes.filter("depth > 0").withColumn("_d", F.col("depth") - 1)
    small = nodes.filter("n_children > 0").select(F.col("depth").alias("_d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    got = salted_join(big, small, on, "_n", ["k1"]).drop("_d", "_n")
    return got.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def rollup(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens), summed over each node's subtree.

    Every node of a subtree is on the path of its own smallest member, who is a
    member of the subtree's top: so the figures are put on that path, summed
    from its end up to the top, and the paths' sums added."""
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    zero = F.lit(0).cast("long")
    held = cut(paths.select("conv_id", *NODE).join(own, ["conv_id", "depth"], "left").withColumns({"_b": -F.floor(F.col("depth") / BLOCK), "leaf": F.coalesce("leaf", zero), "saved": F.coalesce("saved", zero)}))
    up = running(held, ["conv_id"], ["_b"], [F.col("depth").desc()], {"n_leaves": (F.col("leaf"), "sum"), "saved_tokens": (F.col("saved"), "sum")})
    return up.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, h1, h2, words, size,
    with a row of depth 0 for each conversation): depth, k1, k2, conv_id
    (smallest member), parent_conv_id (null: root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  No conversation: no row."""
    paths = cut(paths_of(cut(turns)))
    convs, shards = paths.filter("depth = 0").count(), FAN
    while convs > shards * SHARD_CONVS:
        shards *= FAN
    nodes = cut(with_children(cut(merge_tries(partial_tries(paths, shards), shards))))
    out = with_parents(nodes).drop("p1", "p2", "words")
    out = out.join(rollup(paths, nodes), list(NODE)).join(end_digests(end_lists(paths)), list(NODE), "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row for each node.

    Null roles and texts are empty, null turns come first, rows of one turn are
    ordered by hashes of role and text; repeated rows are turns of their own;
    rows without a conv_id are in no conversation.  Other columns aren't read."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    nodes = trie(rebuilt(cut(turns_of(rows))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of an ASCII string, bit by bit.
CRC32 = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"

OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(t ORDER BY pos) AS t, list(w ORDER BY pos) AS w, {CRC32.format(s="conv_id::VARCHAR")} % 4 AS h FROM own GROUP BY conv_id),
again AS (
  SELECT c.conv_id, coalesce(b.t[1:c.h], []) || coalesce(c.t[c.h + 1:], []) AS t, coalesce(b.w[1:c.h], []) || coalesce(c.w[c.h + 1:], []) AS w
  FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (
  SELECT conv_id, len(t) AS size, d AS depth, md5(array_to_string(t[1:d], ',')) AS k, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, md5(array_to_string(t[1:d - 1], ',')) AS p
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM again)),
nodes AS (
  SELECT depth, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
  FROM paths GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, p AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, k)),
below AS (
  SELECT a.depth, a.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM full_nodes f JOIN paths a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (depth, k) LEFT JOIN nodes up ON f.depth > 0 AND up.depth = f.depth - 1 AND up.k = f.p
"""
