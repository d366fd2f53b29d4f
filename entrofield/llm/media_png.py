"""Binary media columns: payloads stored losslessly as PNG, decoded with checksum tests and numpy unfiltering, and hashed by low-frequency cosine coefficients.

Container: signature, IHDR (8-bit grey, WIDTH samples a row), a private ancillary chunk `teLn` with the unpadded length, IDAT (zlib), IEND; every chunk's
CRC-32 is tested on reading. The writer chooses, per row, the one of the five filters with the least sum of absolute differences (or `none` for all, which packs text
tighter); the reader undoes them with numpy: runs of rows with none, sub or up at once, images with average or Paeth rows by antidiagonals, whose samples only need
those of the two before. The hash is perceptual: samples averaged to 32 x 32, the 8 x 8 lowest cosine coefficients, each bit whether a coefficient is
above their median (the constant term left out), packed into a binary column of 8 bytes.

Null and empty texts are 64 zero bytes. Equal payloads give equal bytes and hashes. Keys may be null or repeated. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, slices, stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LENGTH_CHUNK = b"teLn"
SIDE, LOW, LANES = 32, 8, 32
#: The lowest LOW cosine basis vectors over SIDE samples.
BASIS = np.cos(np.pi * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None] / SIDE).astype(np.float32)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """To a positive multiple of width with zero bytes."""
    return data + bytes(-len(data) % width if data else width)


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours (16-bit) the one nearest to left + up - corner; ties in the order left, up, corner."""
    to_left, to_up = np.abs(up - corner), np.abs(left - corner)
    to_corner = np.abs(left + up - 2 * corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def filtered(rows: np.ndarray, adaptive: bool) -> np.ndarray:
    """Rows with their filter byte in front; adaptive takes, per row, the filter with the least sum of absolute differences."""
    h, w = rows.shape
    out = np.zeros((h, w + 1), np.uint8)
    out[:, 1:] = rows
    if adaptive:
        x = np.zeros((h + 1, w + 1), np.int16)
        x[1:, 1:] = rows
        left, up, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
        each = np.stack([rows, *[(rows - guess).astype(np.uint8) for guess in (left, up, (left + up) >> 1, paeth(left, up, corner))]])
        kind = np.abs(each.view(np.int8).astype(np.int16)).sum(2).argmin(0)
        out[:, 0] = kind
        out[:, 1:] = each[kind, np.arange(h)]
    return out


def encode_png(data: bytes, adaptive: bool = True, level: int = 6) -> bytes:
    rows = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, chunk(b"IHDR", head), chunk(LENGTH_CHUNK, struct.pack(">Q", len(data))), chunk(b"IDAT", zlib.compress(filtered(rows, adaptive).tobytes(), level)), chunk(b"IEND", b"")])


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk up to IEND, after testing its checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while True:
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        (crc,) = struct.unpack_from(">I", data, at + 8 + n)
        if zlib.crc32(body, zlib.crc32(kind)) != crc:
            raise ValueError(f"checksum of chunk {kind!r} differs")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Undoes the row filters of 8-bit grey rows."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    if kinds.max() > 2:
        return by_diagonals([raw])[0]
    out = np.zeros_like(rows)
    zero = np.zeros(rows.shape[1], np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for i, j in zip(edges, edges[1:]):
        kind, above = kinds[i], out[i - 1] if i else zero
        if kind == 0:
            out[i:j] = rows[i:j]
        elif kind == 1:
            out[i:j] = np.cumsum(rows[i:j], axis=1, dtype=np.uint8)
        else:
            out[i:j] = np.cumsum(np.vstack([above[None], rows[i:j]]), axis=0, dtype=np.uint8)[1:]
    return out


def by_diagonals(images: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Undoes any filters of images of one width, rows with their filter byte in front: the samples (row, d - row) of an antidiagonal d at once, from the two before it.

    Images stand one below the other with a row of zeros above each, in up to LANES lanes that advance together.
    """
    w, sizes = images[0].shape[1] - 1, [len(x) + 1 for x in images]
    n_lanes = max(1, min(LANES, sum(sizes) // max(sizes)))
    ends, place = [0] * n_lanes, []
    for n in sizes:
        lane = ends.index(min(ends))
        place.append((lane, ends[lane] + 1))
        ends[lane] += n
    h = max(ends)
    raw = np.zeros((n_lanes, h, w + 1), np.uint8)
    for x, (lane, at) in zip(images, place):
        raw[lane, at : at + len(x)] = x
    kinds, data, out = raw[:, :, 0], raw[:, :, 1:].reshape(n_lanes, -1), np.empty((n_lanes, h * w), np.uint8)
    is_left, is_up, is_mean, is_paeth = ((kinds == k).astype(np.int16) for k in (1, 2, 3, 4))
    before, last, new = (np.zeros((n_lanes, h + 1), np.int16) for _ in range(3))  # by row, one place on; row -1 is zeros
    for d in range(h + w - 1):
        lo, hi = max(0, d - w + 1), min(h, d + 1)
        left, up, corner = last[:, lo + 1 : hi + 1], last[:, lo:hi], before[:, lo:hi]
        guess = is_left[:, lo:hi] * left + is_up[:, lo:hi] * up + is_mean[:, lo:hi] * ((left + up) >> 1) + is_paeth[:, lo:hi] * paeth(left, up, corner)
        at = slice(d + lo * (w - 1), d + (hi - 1) * (w - 1) + 1, max(1, w - 1))
        new[:, lo + 1 : hi + 1] = (guess + data[:, at]) & 255
        out[:, at] = new[:, lo + 1 : hi + 1]
        before, last, new = last, new, before
    out = out.reshape(n_lanes, h, w)
    return [out[lane, at : at + len(x)] for x, (lane, at) in zip(images, place)]


def inflated(data: bytes) -> tuple[np.ndarray, int | None]:
    """Filtered rows with their filter byte in front, and the length kept in the private chunk, if any."""
    width = height = 0
    length, parts = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
        elif kind == LENGTH_CHUNK:
            (length,) = struct.unpack(">Q", body)
        elif kind == b"IDAT":
            parts.append(body)
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1), length


def decode_png(data: bytes) -> tuple[np.ndarray, int | None]:
    """Samples (height x width) and the length kept in the private chunk, if any."""
    raw, length = inflated(data)
    return unfilter(raw), length


def decode_pngs(media: Sequence[bytes]) -> Iterator[tuple[np.ndarray, int | None]]:
    """decode_png() of each, those that need antidiagonals together."""
    raw = [inflated(x) for x in media]
    slow: dict[int, list[int]] = {}
    for i, (x, _) in enumerate(raw):
        if len(x) and x[:, 0].max() > 2:
            slow.setdefault(x.shape[1], []).append(i)
    done = {}
    for at in slow.values():
        done.update(zip(at, by_diagonals([raw[i][0] for i in at])))
    for i, (x, length) in enumerate(raw):
        yield done.get(i) if i in done else unfilter(x), length


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: signs of the lowest cosine coefficients of the averaged samples against their median."""
    h, w = samples.shape
    at = np.arange(SIDE) * h // SIDE
    n = np.maximum(1, np.diff(np.append(at, h)))
    rows = np.add.reduceat(samples, at, axis=0, dtype=np.float32) / n[:, None]
    at = np.arange(SIDE) * w // SIDE
    n = np.maximum(1, np.diff(np.append(at, w)))
    small = np.add.reduceat(rows, at, axis=1) / n
    low = (BASIS @ small.astype(np.float32) @ BASIS.T).ravel()
    low = np.round(low, 3)  # equal payloads already give equal sums; rounding keeps zero coefficients at zero
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(batches: Iterator[pa.RecordBatch], adaptive: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        media = [encode_png((t or "").encode("utf-8", "surrogatepass"), adaptive) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for b in slices(batches):
        rows = []
        every = b.column(1).to_pylist()
        for media, (samples, n) in zip(every, decode_pngs(every)):
            payload = samples.tobytes()
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)


def store_media(docs: DataFrame, path: str | None = None, adaptive: bool = True) -> DataFrame:
    """Writes doc_id and the PNG of each text's UTF-8 bytes to a table in the shared folder and returns that table."""
    bounded_batches(docs.sparkSession)
    path = path or shared_dir(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lambda it: _encode(it, adaptive), "doc_id long, media binary"), path)


def media_features(media: DataFrame) -> DataFrame:
    """Decodes each stored PNG and returns its lengths, checksums and cosine hash."""
    return media.select("doc_id", "media").mapInArrow(lambda it: _features(it), FEATURES)
