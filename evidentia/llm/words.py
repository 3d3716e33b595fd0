"""Vectorised word scanning and hashing of Arrow string columns.

Texts are handled as UTF-8 bytes.  A word is a maximal run of bytes outside
0x20 and 0x09-0x0D; every other byte belongs to a word, so multi-byte
characters never split.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing of A-Z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_BASE = 0x9E3779B97F4A7C13  # = 3 mod 8
SEQ_BASES = (0xC2B2AE3D27D4EB4B, 0xD6E8FEB86659FD93)  # = 3 mod 8
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        got = tuple(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]).cumprod(dtype=U64) for b in (base, inv))
        if size <= 1 << 21:
            _powers[base] = got
    return got


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, two and
    more beside an executor's own memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a run of texts.  ``buf`` holds the bytes with one
    separator after each text; ``starts``/``ends`` are the words' places in it
    and ``woff`` the index of each text's first word (and the total)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(offsets) - 1
        self.n_docs = n
        self.doc_start = offsets[:-1] + np.arange(n)
        self.doc_end = offsets[1:] + np.arange(n)
        buf = np.full(len(data) + n, 0x20, np.uint8)
        keep = np.ones(len(buf), bool)
        keep[self.doc_end] = False
        buf[keep] = LOWER[data] if lower else data
        self.buf = buf
        inside = ~WS[buf]
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.woff = np.concatenate([np.searchsorted(self.starts, self.doc_start), [len(self.starts)]]).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.woff)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same everywhere.  Sums run over
        about 1 MB of bytes at a time."""
        out, i = np.empty(len(self.starts), U64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + (1 << 20), "right")))
            s, e = self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i]
            part = self.buf[self.starts[i] : self.ends[j - 1]]
            fwd, back = powers(BYTE_BASE, len(part) + 1)
            pre = np.zeros(len(part) + 1, U64)
            np.cumsum(BYTE_VALUE[part] * fwd[: len(part)], out=pre[1:])
            out[i:j] = mix((pre[e] - pre[s]) * back[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
            i = j
        return out

    def join_kept(self, keep: np.ndarray) -> pa.Array:
        """Per text, its kept words joined by one space."""
        mark = np.zeros(len(self.buf) + 1, np.int8)
        s, e = self.starts[keep], self.ends[keep]
        mark[s] += 1
        np.subtract.at(mark, e + 1, 1) if len(e) else None
        take = np.cumsum(mark[:-1]) > 0
        csum = np.concatenate([[0], np.cumsum(keep)])
        n_kept = csum[self.woff[1:]] - csum[self.woff[:-1]]
        last = csum[self.woff[1:]][n_kept > 0] - 1
        take[e[last]] = False
        out = self.buf.copy()
        out[WS[out]] = 0x20
        pos = np.concatenate([[0], np.cumsum(take)])
        offsets = np.concatenate([pos[self.doc_start], [pos[-1]]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(self.n_docs, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[take].tobytes())).cast(pa.string())


def chunks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``max_bytes`` bytes (a longer text is a
    run of its own): first row, row past the last, bytes, offsets."""
    data, off = buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def ranges(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of arange(first[i], first[i] + lens[i])."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(first - before, lens) + np.arange(total)


def sequence_hashes(h: np.ndarray, at: np.ndarray, k: np.ndarray | int, which: int) -> np.ndarray:
    """Hash of the k words that start at each index of ``at``; h: word hashes."""
    fwd, back = powers(SEQ_BASES[which], len(h) + 1)
    x = h if not which else mix(h ^ U64(0x5851F42D4C957F2D))
    pre = np.zeros(len(h) + 1, U64)
    np.cumsum(x * fwd[: len(h)], out=pre[1:])
    out = (pre[at + k] - pre[at]) * back[at]
    return mix(out + np.asarray(k, np.int64).astype(U64) * U64(0xD1342543DE82EF95))
