"""Histogram-sort sharding: equal-bytes shards of a hashed key order.

The key order is the unsigned order of a 64-bit hash of the key columns.  The
exact bytes below candidate boundaries are counted over all partitions; the
cells that hold a splitter are probed again with finer boundaries until every
splitter is met within the tolerance (or its cell can't be split); then the
rows are exchanged once.  DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .spark_util import cut, documents

KEY_BITS = 63


def _cell(level: int) -> Column:
    return F.shiftrightunsigned(F.col("_key"), KEY_BITS - level)


def find_cells(narrow: DataFrame, n_shards: int, tolerance: float, first_bits: int, step_bits: int, rows_per_cell: int):
    """Cells [lo, hi) of the key order with their exact bytes and rows, finest
    where splitters fall.  narrow: (_key, _size).  The driver holds at most
    2**first_bits cells and then 2**step_bits for each splitter and round."""
    level = first_bits
    need = narrow.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    while need > rows_per_cell << level and level < 20:
        level += 1
    cells = {}
    for r in narrow.groupBy(_cell(level).alias("c")).agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        cells[r["c"] << (KEY_BITS - level)] = (level, r["b"], r["n"])
    total = sum(b for _, b, _ in cells.values())
    slack = tolerance * total / n_shards
    while True:
        at, below = sorted(cells), 0
        probe = []
        for lo in at:
            lv, b, n = cells[lo]
            inside = any(below + slack < total * s / n_shards < below + b - slack for s in range(1, n_shards))
            if inside and n > 1 and lv < KEY_BITS:
                probe.append(lo)
            below += b
        if not probe:
            return at, cells, total
        by_level: dict[int, list[int]] = {}
        for lo in probe:
            by_level.setdefault(cells[lo][0], []).append(lo)
        for lv, los in by_level.items():
            fine = min(KEY_BITS, lv + step_bits)
            hit = _cell(lv).isin([lo >> (KEY_BITS - lv) for lo in los])
            rows = narrow.filter(hit).groupBy(_cell(fine).alias("c")).agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
            for lo in los:
                del cells[lo]
            for r in rows:
                cells[r["c"] << (KEY_BITS - fine)] = (fine, r["b"], r["n"])


def shard_by_bytes(
    df: DataFrame,
    size: Column,
    key: list[Column],
    n_shards: int = 24,
    tolerance: float = 0.001,
    first_bits: int = 10,
    step_bits: int = 6,
    rows_per_cell: int = 50_000,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (0 to n_shards-1) and
    ``slot`` (place in the shard, gapless from 0, in key order).

    The shards' sums of ``size`` differ from the mean by at most ``tolerance``
    of it and one row at either end; rows whose keys are equal in all columns
    stay in one cell.  Null keys hash as any other value; a null size counts
    as 0; an empty table gives an empty result.  Columns of those two names are
    replaced; others may have any name that doesn't begin with ``_``.

    Slots are numbered within cells.  There are 2**20 cells at most (about 30
    MB, which the driver collects and broadcasts), so a cell grows beyond
    ``rows_per_cell`` rows from 5e10 rows on: 100,000 rows at 1e11.
    """
    size = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    ties = [f"_k{i}" for i in range(len(key))]
    keyed = df.withColumns({"_key": F.shiftrightunsigned(F.xxhash64(*key), 1), "_size": size, **dict(zip(ties, key))}).drop("shard", "slot")
    narrow = cut(keyed.select("_key", "_size"))
    at, cells, total = find_cells(narrow, n_shards, tolerance, first_bits, step_bits, rows_per_cell)
    table, below, shard, slot = [], 0, 0, 0
    ends = [total * s / n_shards for s in range(1, n_shards)]
    for lo in at:
        lv, b, n = cells[lo]
        s = bisect_right(ends, below + b / 2)
        if s != shard:
            shard, slot = s, 0
        table.append((lo, lv, shard, slot))
        below, slot = below + b, slot + n
    schema = T.StructType([T.StructField(c, t) for c, t in (("_lo", T.LongType()), ("_lv", T.IntegerType()), ("shard", T.IntegerType()), ("_slot0", T.LongType()))])
    small = df.sparkSession.createDataFrame(table, schema)
    levels = sorted({lv for _, lv, _, _ in table}) or [first_bits]
    # a row's cell is at one of a few levels: try each, an equi-join on (level, prefix)
    options = F.array(*(F.struct(F.lit(lv).alias("_lv"), F.shiftleft(_cell(lv), KEY_BITS - lv).alias("_lo")) for lv in levels))
    if len(levels) == 1:
        placed = keyed.withColumns({"_lv": options[0]["_lv"], "_lo": options[0]["_lo"]})
    else:
        marks = {}
        for lv in levels[:-1]:
            marks[lv] = [lo >> (KEY_BITS - lv) for lo in at if cells[lo][0] > lv]
        chosen = None
        for lv in reversed(levels):
            pick = F.struct(F.lit(lv).alias("_lv"), F.shiftleft(_cell(lv), KEY_BITS - lv).alias("_lo"))
            deeper = sorted(set(marks.get(lv, [])))
            chosen = pick if chosen is None else F.when(_cell(lv).isin(deeper), chosen).otherwise(pick)
        placed = keyed.withColumn("_c", chosen).withColumns({"_lv": F.col("_c._lv"), "_lo": F.col("_c._lo")}).drop("_c")
    # `small` has a row for each cell: bounded by the probing, not by the rows
    joined = placed.join(F.broadcast(small), ["_lo", "_lv"])
    order = W.partitionBy("_lo", "_lv", "shard", "_slot0").orderBy("_key", *ties)
    return joined.withColumn("slot", F.col("_slot0") + F.row_number().over(order) - 1).drop("_key", "_size", "_lo", "_lv", "_slot0", *ties)


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of nearly equal bytes."""
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    out = shard_by_bytes(rows, F.col("size"), [F.col("doc_id"), F.col("text_crc32")])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
