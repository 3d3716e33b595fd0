"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a token budget.  It is filled with complete epochs of the
source first; the rest is a weighted sample without replacement: every document
draws the exponential key -ln(u)/quality, the source is read in key order, and
documents are taken while the running sum of tokens is below the budget.  The
order is never built for a whole source: the keys are binned, bins are
prefix-summed, the bin where the budget ends is binned again until it is small,
and only its rows are ordered.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .spark_util import MOST_HOT, cut, documents, n_words, salted_join, table_cut

#: Weights of the sources in code-point order, repeating.
CYCLE = (3.0, 1.0, 2.0)
MADE = ("size", "source_size", "target", "taken")
#: Bits of a key's place, key / (1 + key) of the unit interval: even for any quality once refined.
PLACE_BITS = 52


def quality_weight(text: Column) -> Column:
    """A document's sampling weight, 0.25 to 1: a quarter, and three quarters
    of the share of its characters that aren't ASCII digits or symbols."""
    odd = F.length(F.regexp_replace(text, r"[^0-9#*$%&|<>!_=+~^@\\/{}\[\]]", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * odd / F.greatest(F.length(text), F.lit(1)), F.lit(0.25))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """sources: one row for each source (source, source_size, ...).  Adds
    ``weight`` and ``target``: shares of ``share`` times all sizes by weight,
    none above ``most`` times its source's size, the excess reshared by weight.

    Resharing until no target is above its cap ends at the level L where the
    targets min(cap, L * weight) make the sum; L is found by sorting the
    sources by cap / weight.  The window holds one row per source.
    """
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    by = everything.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    s = s.withColumn("_l", level).withColumn("_ok", F.col("_l") * F.col("weight") <= F.col("_cap"))
    s = s.withColumn("_level", F.min(F.when(F.col("_ok"), F.struct(F.col("_cap") / F.col("weight"), F.col("_l").alias("l")))).over(everything)["l"])
    target = F.when(F.col("_level").isNull() | (F.col("_level") * F.col("weight") > F.col("_cap")), F.col("_cap")).otherwise(F.col("_level") * F.col("weight"))
    return s.select(*sources.columns, "weight", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    quality: Column,
    share: float = 1.5,
    most: float = 2.0,
    cycle: tuple[float, ...] = CYCLE,
    rows_per_bin: int = 1_000,
    bin_bits: int = 10,
    seed: int = 17,
    unit: Column | None = None,
) -> DataFrame:
    """All rows of ``docs`` (source, ...) with ``size``, ``source_size``,
    ``target`` of the source and ``taken`` tokens.

    taken is size times the complete epochs, plus size where the fractional
    epoch takes the document; the one whose middle is at the budget's end is
    the last.  Null sources form a source; null or empty texts have size 0 and
    take 0; an empty table gives an empty result.  Keys come from a hash of all
    columns (but maps), so reruns agree whatever the order of rows, and only
    rows that are equal in all columns tie, of which any is as good; or from
    ``unit``, a number above 0 and below 1 that names the row.  A null
    quality counts as a quarter.  Input columns named like a result are
    replaced; others may have any name that doesn't begin with ``_``.

    ``size`` and ``quality`` are computed once: the rows are written to the
    shared folder, and sums and bins read three narrow columns of them.
    """
    hashed = sorted(f.name for f in docs.schema if not isinstance(f.dataType, T.MapType))
    if unit is None:
        unit = (F.pmod(F.xxhash64(F.lit(seed), *hashed), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(unit) / F.greatest(F.coalesce(quality.cast("double"), F.lit(0.25)), F.lit(1e-6))
    rows = docs.withColumns({"_size": F.coalesce(size.cast("long"), F.lit(0).cast("long")), "_es": key}).drop(*MADE)
    rows = table_cut(rows)
    narrow = rows.select("source", "_size", "_es")
    sums = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    plan = source_targets(sums, share, most, cycle)
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    # the bin where the budget ends (at first one for the whole source), the tokens before it, and its rows
    plan = cut(plan.select("*", F.lit(0).cast("long").alias("_end"), F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_inside")))
    few = plan.count() <= MOST_HOT
    place = F.least(F.floor(F.col("_es") / (F.col("_es") + 1) * F.lit(float(1 << PLACE_BITS))).cast("long"), F.lit((1 << PLACE_BITS) - 1))

    def with_plan(df: DataFrame, p: DataFrame) -> DataFrame:
        """Rows with their source's plan: no rows are moved unless there are
        very many sources, and then none of a hot source to one task."""
        if few:
            p = F.broadcast(p.withColumnRenamed("source", "_s"))
            return df.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        k = {"_k": F.coalesce("source", F.lit("")), "_z": F.col("source").isNull()}
        return salted_join(df.withColumns(k), p.withColumns(k).drop("source"), ["_k", "_z"], "_n", ["_es", "_size"]).drop("_k", "_z")

    bits = 0
    while bits < PLACE_BITS and (plan.agg(F.max("_inside")).first()[0] or 0) > rows_per_bin:
        was, bits = bits, min(PLACE_BITS, bits + bin_bits)
        inside = with_plan(narrow, plan.select("source", "_n", "_end", "_before", "_rest")).filter(F.shiftright(place, PLACE_BITS - was) == F.col("_end"))
        bins = inside.groupBy("source", F.shiftright(place, PLACE_BITS - bits).alias("_bin")).agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_r"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
        # at most 2**bin_bits bins of a source
        upto = F.col("_before") + F.sum("_b").over(W.partitionBy("source").orderBy("_bin"))
        ends = bins.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_rest"))
        ends = ends.groupBy("source").agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_b")).alias("_before"), "_r")).alias("e"))
        ends = ends.select(F.col("source").alias("_s"), "e.*").withColumnRenamed("_before", "_now")
        # a source of no tokens has no end and takes nothing
        plan = cut(
            plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumns({"_end": F.coalesce("_bin", F.lit(0).cast("long")), "_before": F.coalesce("_now", F.lit(0).cast("long")), "_inside": F.coalesce("_r", F.lit(0).cast("long"))})
            .select(*plan.columns)
        )
    full = with_plan(rows, plan).withColumn("_bin", F.shiftright(place, PLACE_BITS - bits))
    inside = (F.col("_bin") == F.col("_end")) & (F.col("source_size") > 0)
    clear = full.filter(~inside).withColumn("_in", F.col("_bin") < F.col("_end"))
    order = W.partitionBy("source").orderBy("_es").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = full.filter(inside).withColumn("_in", F.col("_before") + F.sum("_size").over(order) - F.col("_size") / 2 <= F.col("_rest"))
    out = clear.unionByName(edge)
    taken = F.col("_size") * (F.col("_epochs") + F.col("_in").cast("long"))
    names = [c for c in docs.columns if c not in MADE]
    return out.select(*names, F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their words.  A row's number comes
    from the MD5 of its id and its text's MD5."""
    docs = documents(spark, sf_dir)
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    unit = (F.conv(F.substring(name, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select("doc_id", "source", unit.alias("u"), n_words(F.col("text")).alias("w"), quality_weight(F.col("text")).alias("q"))
    out = mix_sources(rows, F.col("w"), F.col("q"), unit=F.col("u"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


#: The same by ordering whole sources.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
  CASE WHEN text IS NULL THEN 0.25::DOUBLE ELSE 1::DOUBLE - 0.75::DOUBLE * len(regexp_extract_all(text, '[0-9#*$%&|<>!_=+~^@\\/{}\[\]]')) / greatest(length(text), 1) END AS q FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 2.0::DOUBLE * sum(size) AS cap, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS wt FROM d GROUP BY source),
lv AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS l FROM s),
lx AS (SELECT *, (SELECT arg_min(l, cap / wt) FROM lv WHERE l * wt <= cap) AS level FROM lv),
tg AS (SELECT source, n, CASE WHEN level IS NULL OR level * wt > cap THEN cap ELSE level * wt END AS target FROM lx),
p AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs, target - CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END * n AS rest FROM tg),
o AS (SELECT d.*, n, target, epochs, rest, sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / greatest(q, 1e-6::DOUBLE), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n AS source_size, target, (size * (epochs + (upto - size / 2.0 <= rest)::INT))::BIGINT AS taken FROM o"""
