"""Counting many keys over blocks of documents without shuffling the keys.

A block (a few MB of text, dealt by a hash) sends, for each slice of the key
space, its sorted distinct keys as byte planes of their differences, with a
count each.  The task of a slice adds the blocks' counts and answers each block
with a small number for each key, in the order they were sent.  The bytes per
key shrink as lists grow, answers are keyed by block and slice, and a key that
is in every block is one entry per block: no hot groups.

A block cuts its keys into at most ``1 << COARSE_BITS`` lists.  Where the input
needs more slices, blocks are merged in two levels: groups of ``FAN`` blocks
add up each of their coarse slices, and send it on in fine ones.  So lists stay
longer than a few hundred keys, and a task merges a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import tidy

U64 = np.uint64
LIST = "block int, slice int, kind string, payload binary, extra binary"
ANSWER = "block int, slice int, kind string, payload binary"
ANSWER_COLUMNS = ["block", "slice", "kind", "payload"]
#: A block of 6 MB has about a million keys: lists of a thousand.
COARSE_BITS, FAN = 10, 1024


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, lowest first; high planes of zeros are
    left out."""
    if not len(x):
        return b""
    x = np.ascontiguousarray(x, "<u8")
    n = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    n = raw[0]
    x = np.frombuffer(raw, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :n] = x.T
    return out.view("<u8").reshape(-1)


def deltas(sorted_keys: np.ndarray) -> bytes:
    """Ascending keys, at least one."""
    return sorted_keys[:1].astype("<u8").tobytes() + planes(np.diff(sorted_keys))


def undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1), unplanes(raw[8:])]), dtype=U64)


def small_numbers(x: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1: the least, and bits, nibbles or byte planes
    of the rest."""
    low = int(x.min())
    rest = (x - low).astype(U64)
    top = int(rest.max())
    head = np.array([low, len(x)], "<u4").tobytes()
    if top <= 1:
        return head + b"b" + np.packbits(rest.astype(bool)).tobytes()
    if top <= 15:
        half = np.append(rest, np.zeros(len(rest) % 2, U64)).astype(np.uint8)
        return head + b"n" + (half[::2] | half[1::2] << 4).tobytes()
    return head + b"p" + planes(rest)


def un_small_numbers(raw: bytes) -> np.ndarray:
    low, n = (int(v) for v in np.frombuffer(raw, "<u4", 2))
    kind, body = raw[8:9], raw[9:]
    if kind == b"b":
        rest = np.unpackbits(np.frombuffer(body, np.uint8), count=n)
    elif kind == b"n":
        x = np.frombuffer(body, np.uint8)
        rest = np.stack([x & 15, x >> 4], axis=1).reshape(-1)[:n]
    else:
        rest = unplanes(body)
    return rest.astype(np.int64) + low


def block_column(doc_id: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(n_blocks)).cast("int")


def n_blocks_for(chars: int, block_bytes: int) -> int:
    return max(1, -(-chars // block_bytes))


def slices_for(keys: int, per_slice: int = 4_000_000) -> int:
    """A power of two of slices, so that a slice is a prefix of the key."""
    return 1 << max(0, (-(-max(1, keys) // per_slice) - 1).bit_length())


def slice_runs(sorted_keys: np.ndarray, key_bits: int, n_slices: int) -> Iterator[tuple[int, int, int]]:
    """Slices that hold keys: number, first key, past the last."""
    if not len(sorted_keys):
        return
    shift = key_bits - (n_slices.bit_length() - 1)
    s = (sorted_keys >> U64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(sorted_keys), np.int64)
    first = np.flatnonzero(np.diff(s, prepend=-1))
    yield from zip(s[first].tolist(), first.tolist(), [*first[1:].tolist(), len(s)])


def sorted_counts(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the weights of each."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(weights[order].astype(np.int64), first)


def lists_of(rows: list[tuple[int, str, np.ndarray, np.ndarray]], key_bits: int = 64, n_slices: int = 1) -> pa.Table:
    """rows: block, kind, ascending keys below 2**key_bits, counts."""
    n_slices = min(n_slices, 1 << COARSE_BITS)
    return list_table([(block, s, kind, deltas(keys[a:b]), small_numbers(n[a:b])) for block, kind, keys, n in rows for s, a, b in slice_runs(keys, key_bits, n_slices)])


def list_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    return pa.table({"block": pa.array(cols[0], pa.int32()), "slice": pa.array(cols[1], pa.int32()), "kind": pa.array(cols[2], pa.string()), "payload": pa.array(cols[3], pa.binary()), "extra": pa.array(cols[4], pa.binary())})


def answer_table(rows: list[tuple]) -> pa.Table:
    return list_table([(*r, b"") for r in rows]).drop_columns("extra")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of the lists, their totals, each entry's index among them,
    and the places where the lists begin and end."""
    keys = [undeltas(p) for p in table.column("payload").to_pylist()]
    n = np.concatenate([un_small_numbers(x) for x in table.column("extra").to_pylist()])
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, n, minlength=len(u)).astype(np.int64)
    return u, total, inverse, np.concatenate([[0], np.cumsum([len(x) for x in keys])])


def _answered(table: pa.Table, values: np.ndarray, at: np.ndarray) -> pa.Table:
    cols = (table.column(c).to_pylist() for c in ("block", "slice", "kind"))
    return answer_table([(*r, small_numbers(values[at[i] : at[i + 1]])) for i, r in enumerate(zip(*cols))])


def count_answers(sent: DataFrame, key_bits: int, n_slices: int, answer: Callable[[np.ndarray], np.ndarray], yes_no: str = "", through: str = "") -> DataFrame:
    """sent: lists of blocks, made by ``lists_of``.  To each list the answers to
    the totals of its keys, numbers below 2**32, as ANSWER rows; to lists of
    the kind ``yes_no`` 1 at most.  Rows of the kind ``through`` are handed on as
    they are."""

    def merge(key, table):
        if key[1].as_py() == through:
            return table.select(ANSWER_COLUMNS)
        _, total, inverse, at = _merged(table)
        values = answer(total).astype(np.int64)
        return _answered(table, (np.minimum(values, 1) if key[1].as_py() == yes_no else values)[inverse], at)

    if n_slices <= 1 << COARSE_BITS:
        return sent.groupBy("slice", "kind").applyInArrow(tidy(merge), ANSWER)

    down = n_slices.bit_length() - 1 - COARSE_BITS
    group = F.floor(F.col("block") / F.lit(FAN)).cast("int").alias("g")

    def add_up(key, table):
        kind = key[2].as_py()
        if kind == through:
            return list_table([])
        u, total, _, _ = _merged(table)
        return list_table([(key[0].as_py(), s, kind, deltas(u[a:b]), small_numbers(total[a:b])) for s, a, b in slice_runs(u, key_bits, n_slices)])

    def hand_down(key, table, side):
        if key[2].as_py() == through:
            return table.select(ANSWER_COLUMNS)
        _, _, inverse, at = _merged(table)
        return _answered(table, answers(side, key[2].as_py())[inverse], at)

    lists = sent.select("*", group)
    fine = lists.groupBy("g", "slice", "kind").applyInArrow(tidy(add_up), LIST).groupBy("slice", "kind").applyInArrow(tidy(merge), ANSWER)
    back = fine.withColumn("coarse", F.shiftright("slice", down))
    return lists.groupBy("g", "slice", "kind").cogroup(back.groupBy("block", "coarse", "kind")).applyInArrow(tidy(hand_down), ANSWER)


def answers(side: pa.Table, kind: str) -> np.ndarray:
    """The answers of one kind in the order of the keys that were sent."""
    rows = [(s, p) for s, k, p in zip(side.column("slice").to_pylist(), side.column("kind").to_pylist(), side.column("payload").to_pylist()) if k == kind]
    return np.concatenate([un_small_numbers(p) for _, p in sorted(rows)]) if rows else np.zeros(0, np.int64)
