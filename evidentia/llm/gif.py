"""GIF media columns: timed frames stored losslessly, decoded and measured.

``encode`` writes GIF89a frames with LZW code streams; ``decode`` reads any
GIF: global and local palettes, interlacing, sub-images, transparency and the
disposal methods, giving composed RGBA frames with their delays.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_map import with_text_features
from .spark_util import documents
from .words import buffers

#: A payload is a positive multiple of this many bytes: one row of samples.
ROW = 576
FRAME_ROWS = 64
GREY = bytes(x for v in range(256) for x in (v, v, v))


# ---------------------------------------------------------------- LZW


def _codes_to_bytes(codes: list[int], widths: np.ndarray) -> bytes:
    """Codes as a stream of little-endian bit fields."""
    c = np.asarray(codes, np.uint16)
    bits = np.unpackbits(c.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """LZW code stream of 8-bit samples, ``min_size`` bits at first."""
    clear = 1 << min_size
    codes, counts = [], []  # counts: codes since each clear, with it
    run: list[int] = [clear]
    table: dict[int, int] = {}  # prefix code and next sample to code
    nxt, prefix = clear + 2, -1
    if data:
        prefix = data[0]
        get, add = table.get, run.append
        for x in memoryview(data)[1:]:
            key = prefix << 8 | x
            code = get(key)
            if code is not None:
                prefix = code
            else:
                add(prefix)
                table[key] = nxt
                nxt += 1
                prefix = x
                if nxt == 4096:
                    codes += run
                    counts.append(len(run))
                    run, nxt = [clear], clear + 2
                    add = run.append
                    table.clear()
    if prefix >= 0:
        run.append(prefix)
    run.append(clear + 1)
    codes += run
    counts.append(len(run))
    widths = np.concatenate([_widths(n, min_size, k > 0) for k, n in enumerate(counts)])
    return _codes_to_bytes(codes, widths)


def _widths(n: int, min_size: int, after_full: bool) -> np.ndarray:
    """Bits of the n codes that begin with a clear code.  The k-th code after
    it (from 0) is read when the table holds clear + 2 + max(k - 1, 0)
    entries, and so with the bits that number takes, 12 at most.  The clear
    code that ends a full table has 12."""
    clear = 1 << min_size
    have = clear + 2 + np.maximum(np.arange(n - 1) - 1, 0)
    w = np.minimum(np.frexp(have)[1], 12)
    return np.concatenate([[12 if after_full else min_size + 1], w]).astype(np.int64)


def lzw_decode(stream: bytes, min_size: int, most: int) -> bytes:
    """Samples of an LZW code stream, ``most`` at the longest.  A stream that is
    cut short, or that holds a code without a meaning, gives those before."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, size = 0, min_size + 1
    table, prev = list(base), None
    while at + size <= len(bits):
        # codes up to the next change of size have one width: take them together
        limit = 1 << size
        room = (limit - len(table) + (prev is None)) if size < 12 else 4096
        n = min(max(room, 1), (len(bits) - at) // size)
        codes = np.packbits(bits[at : at + n * size].reshape(n, size), axis=1, bitorder="little")
        codes = codes[:, 0].astype(np.int32) | codes[:, 1].astype(np.int32) << 8 if size > 8 else codes[:, 0].astype(np.int32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stops[0]) if len(stops) else n
        plain = codes[:used].tolist()
        if prev is None and plain:
            if plain[0] >= clear:
                break
            prev = table[plain[0]]
            out.append(prev)
            plain = plain[1:]
        have = len(table)
        growing = plain[: 4096 - have]
        bad = False
        for c in growing:
            if c > have:
                bad = True
                break
            entry = table[c] if c < have else prev + prev[:1]
            table.append(prev + entry[:1])
            have += 1
            out.append(entry)
            prev = entry
        if bad:
            break
        if len(growing) < len(plain):  # a full table: codes only
            out += [table[c] for c in plain[len(growing) :]]
            prev = out[-1]
        at += used * size
        if len(stops):
            if codes[used] == end:
                break
            at += size
            table, prev, size = list(base), None, min_size + 1
        elif len(table) >= 1 << size and size < 12:
            size += 1
    return b"".join(out)[:most]


# ---------------------------------------------------------------- container


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, width: int = ROW, frame_rows: int = FRAME_ROWS, delay_cs: int = 10, palette: bytes = GREY) -> bytes:
    """Frames of up to ``frame_rows`` rows of palette indices, one after the
    other; the payload is a positive multiple of ``width``."""
    rows = len(payload) // width
    if not rows or rows * width != len(payload):
        raise ValueError("the payload is not a positive multiple of the width")
    height = min(rows, frame_rows)
    parts = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", palette]
    for r in range(0, rows, frame_rows):
        h = min(frame_rows, rows - r)
        # disposal 2: a shorter last frame stands on a cleared canvas
        parts.append(b"\x21\xf9\x04\x08" + delay_cs.to_bytes(2, "little") + b"\0\0")
        parts.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0\x08")
        parts.append(_sub_blocks(lzw_encode(payload[r * width : (r + h) * width])))
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """A frame as stored and as shown."""

    left: int
    top: int
    indices: np.ndarray  # rows x columns, as stored
    rgba: np.ndarray  # the canvas when it is shown
    delay_cs: int
    disposal: int
    transparent: int | None


def _rows_of_interlaced(h: int) -> np.ndarray:
    return np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, compose: bool = True) -> list[Frame]:
    """The frames of a GIF.  A file that is cut short gives the frames that
    have begun: those whose header and palette are whole; samples that are
    missing count as index 0.  Anything but a GIF raises ValueError."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    if len(data) < 13:
        return []
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, at = data[10], 13
    palette = None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        if at + n > len(data):
            return []
        palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8) if compose else None
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        out = []
        while at < len(data) and data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(out), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21 and at + 1 < len(data):
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            local, at = data[at + 9], at + 10
            colours = palette
            if local & 0x80:
                n = 3 * (2 << (local & 7))
                if at + n >= len(data):
                    break
                colours, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
            min_size = data[at]
            if not 2 <= min_size <= 8:
                break
            stream, at = blocks(at + 1)
            flat = np.frombuffer(lzw_decode(stream, min_size, w * h), np.uint8)
            if len(flat) < w * h:
                flat = np.concatenate([flat, np.zeros(w * h - len(flat), np.uint8)])
            idx = flat.reshape(h, w)
            if local & 0x40:
                straight = np.empty_like(idx)
                straight[_rows_of_interlaced(h)] = idx
                idx = straight
            shown = None
            if compose:
                before = canvas.copy() if disposal == 3 else None
                area = canvas[top : top + h, left : left + w]
                part = idx[: area.shape[0], : area.shape[1]]
                rgb = colours if colours is not None else np.zeros((256, 3), np.uint8)
                rgb = rgb[np.minimum(part, len(rgb) - 1)]
                if transparent is None:
                    area[..., :3], area[..., 3] = rgb, 255
                else:
                    visible = part != transparent
                    area[visible, :3], area[visible, 3] = rgb[visible], 255
                shown = canvas.copy()
                if disposal == 2:
                    area[:] = 0
                elif disposal == 3:
                    canvas = before
            frames.append(Frame(left, top, idx, shown, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            break
    return frames


def colour_histogram(frame: Frame, bins: int = 8) -> np.ndarray:
    """Visible samples of a shown frame in ``bins`` equal bins of each of the
    red, green and blue channels."""
    shown = frame.rgba[..., 3] > 0
    seen = frame.rgba[..., :3].reshape(-1, 3) if shown.all() else frame.rgba[shown][:, :3]
    levels = [np.bincount(seen[:, c], minlength=256) for c in range(3)]
    return np.stack([np.add.reduceat(x, np.arange(0, 256, 256 // bins)) for x in levels])


# ---------------------------------------------------------------- columns

FRAME_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("frame", T.IntegerType()), T.StructField("start_cs", T.LongType()), T.StructField("delay_cs", T.IntegerType()), T.StructField("rows", T.IntegerType()), T.StructField("histogram", T.ArrayType(T.LongType()))]
    )
)
MEDIA_FIELDS = [
    T.StructField("media", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("frames", FRAME_TYPE),
]


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW)


def store(raw: bytes) -> tuple[bytes, bytes, list[tuple]]:
    """A text's GIF, the payload read back from it, and its frames: number,
    start, delay, rows, red histogram (the three channels are equal)."""
    media = encode(payload_of(raw))
    frames, back, start = [], [], 0
    for k, f in enumerate(decode(media)):
        rows = f.indices.shape[0]
        back.append(f.rgba[:rows, :, 0].tobytes())
        frames.append((k, start, f.delay_cs, rows, colour_histogram(f)[0].tolist()))
        start += f.delay_cs
    return media, b"".join(back), frames


def with_gif(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` plus ``media`` (the GIF of the text's
    UTF-8 bytes, padded with 255 to a positive multiple of 576), ``payload``
    (read back from it) and ``frames``.

    A null text counts as empty: one row of padding.  Equal texts have equal
    media.  Columns of those names are replaced.
    """

    def features(texts: pa.Array) -> dict[str, pa.Array]:
        got = [store(x) for x in _raw(texts)]
        frames = [[dict(zip(("frame", "start_cs", "delay_cs", "rows", "histogram"), f)) for f in g[2]] for g in got]
        kind = pa.list_(pa.struct([("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("rows", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
        return {"media": pa.array([g[0] for g in got], pa.binary()), "payload": pa.array([g[1] for g in got], pa.binary()), "frames": pa.array(frames, kind)}

    return with_text_features(docs, features, MEDIA_FIELDS)


def _raw(texts: pa.Array) -> list[bytes]:
    data, off = buffers(texts)
    raw = data.tobytes()
    return [raw[off[i] : off[i + 1]] for i in range(len(off) - 1)]


DIGEST_FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("n_frames", T.LongType()),
]


def gif_digests(docs: DataFrame) -> DataFrame:
    """``with_gif`` reduced where it is made: digests of the stored and the
    read-back bytes, so that media need not leave the task."""

    def features(texts: pa.Array) -> dict[str, pa.Array]:
        out: dict[str, list] = {f.name: [] for f in DIGEST_FIELDS}
        for raw in _raw(texts):
            media, back, frames = store(raw)
            hist = np.sum([f[4] for f in frames], axis=0).tolist()
            row = (
                len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(),
                ",".join(map(str, hist)), len(frames),
            )
            for f, v in zip(DIGEST_FIELDS, row):
                out[f.name].append(v)
        return {f.name: pa.array(out[f.name], pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in DIGEST_FIELDS}

    return with_text_features(docs, features, DIGEST_FIELDS)


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a GIF and read back."""
    return gif_digests(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
