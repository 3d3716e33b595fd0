"""Running aggregates and row numbers of any group size.

A window over a whole group is one task for it.  Here each group is cut into
blocks by *levels*, columns that rise with the order (a page block, a date, a
kind): the blocks are aggregated, the aggregates are prefix-combined level by
level, and only the rows of one block share a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: How two neighbours combine: aggregate, combination, value of nothing (null: none needed).
HOW = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hint: str | None = None) -> DataFrame:
    """Equi-join on columns where null equals null; the left side's keys stay."""
    r = right.select(*(F.col(c).alias(f"_j_{c}") for c in on), *(c for c in right.columns if c not in on))
    r = r.hint(hint) if hint else r
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, how).drop(*(f"_j_{c}" for c in on))


def block_offsets(blocks: DataFrame, keys: Sequence[str], levels: Sequence[str], values: dict[str, str]) -> DataFrame:
    """blocks: one row for each (keys, levels) with the aggregates named in
    ``values`` (column: kind of HOW).  The same rows with ``_off_<column>``, the
    combination of all earlier blocks of the group.

    A level's window holds the blocks of one parent block.
    """
    keys, levels = list(keys), list(levels)
    own = lambda d: [F.coalesce(F.col(f"_own_{c}"), F.lit(HOW[h][2])).alias(f"_own_{c}") if HOW[h][2] is not None else F.col(f"_own_{c}") for c, h in d.items()]
    at = blocks.select(*keys, *levels, *(F.col(c).alias(f"_own_{c}") for c in values))
    tables = []
    for i in range(len(levels), 0, -1):
        w = W.partitionBy(*keys, *levels[: i - 1]).orderBy(levels[i - 1]).rowsBetween(W.unboundedPreceding, -1)
        tables.append(at.select(*keys, *levels[:i], *(HOW[h][0](f"_own_{c}").over(w).alias(f"_p{i}_{c}") for c, h in values.items())))
        if i > 1:
            at = at.groupBy(*keys, *levels[: i - 1]).agg(*(HOW[h][0](f"_own_{c}").alias(f"_own_{c}") for c, h in values.items())).select(*keys, *levels[: i - 1], *own(values))
    out = tables[0]
    for t, i in zip(tables[1:], range(len(levels) - 1, 0, -1)):
        out = safe_join(out, t, [*keys, *levels[:i]])
    combined = []
    for c, h in values.items():
        _, both, none = HOW[h]
        parts = [F.col(f"_p{i}_{c}") for i in range(1, len(levels) + 1)]
        parts = parts if none is None else [F.coalesce(p, F.lit(none)) for p in parts]
        total = parts[0]
        for p in parts[1:]:
            total = both(total, p)
        combined.append(total.alias(f"_off_{c}"))
    return out.select(*keys, *levels, *combined)


def running(df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[Column, str]], inclusive: bool = True) -> DataFrame:
    """``df`` with a running aggregate for each of ``values`` (name: (column,
    kind of HOW)) over its group's rows in ``order`` up to this one, itself
    included or not.

    keys may be null (one group); levels must be non-null columns of ``df``
    that never fall in that order.  ``df`` is read twice, so a costly one should
    be written before.  Equal places in the order get theirs in any order.
    """
    keys, levels = list(keys), list(levels)
    kinds = {n: h for n, (_, h) in values.items()}
    src = df.withColumns({f"_v_{n}": c for n, (c, _) in values.items()})
    blocks = src.groupBy(*keys, *levels).agg(*(HOW[h][0](f"_v_{n}").alias(n) for n, h in kinds.items()))
    rows = safe_join(src, block_offsets(blocks, keys, levels, kinds), [*keys, *levels])
    w = W.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    out = {}
    for n, h in kinds.items():
        agg, both, none = HOW[h]
        here, before = agg(f"_v_{n}").over(w), F.col(f"_off_{n}")
        if none is not None:
            here, before = F.coalesce(here, F.lit(none)), F.coalesce(before, F.lit(none))
        out[n] = both(before, here)
    return rows.withColumns(out).drop(*(f"_v_{n}" for n in kinds), *(f"_off_{n}" for n in kinds))


def numbered(df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``, its row number from 1 in its group."""
    return running(df, keys, levels, order, {name: (F.lit(1).cast("long"), "sum")})
