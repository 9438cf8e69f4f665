"""Media columns: Netpbm and BMP images as numpy arrays.

Images are decoded, area-resized by integral images, cut into NPY tiles and
given difference hashes.  Work is row by row inside Arrow batches, so a task
holds one batch and one image at a time.
"""

from __future__ import annotations

import functools
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
_WHITE = b" \t\n\v\f\r"


class MediaError(ValueError):
    """The bytes are no image that this module reads."""


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 8 or 16 bits as
    stored, bitmaps as 0 (black) and 255."""
    kind = data[:2]
    if len(data) < 3 or kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not Netpbm")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _FIELD.match(data, at)
        if not found:
            raise MediaError("broken Netpbm header")
        fields.append(int(found[1]))
        at = found.end()
    width, height, top = (*fields, 1)[:3]
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = int(np.prod(shape, dtype=np.int64))
    if not 0 < top < 65536 or width < 1 or height < 1:
        raise MediaError("broken Netpbm header")
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*\n?|\s", b"", data[at:])[:n]
        if len(bits) < n or bits.strip(b"01"):
            raise MediaError("broken P1 data")
        return np.where(np.frombuffer(bits, np.uint8).reshape(shape) == 48, 255, 0).astype(np.uint8)
    if kind in (b"P2", b"P3"):
        values = np.array([int(x) for x in re.sub(rb"#[^\n]*\n?", b" ", data[at:]).split()[:n]], np.int64)
        if len(values) < n or values.max(initial=0) > top:
            raise MediaError("broken plain data")
        return values.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)
    if data[at : at + 1] not in [_WHITE[i : i + 1] for i in range(6)]:
        raise MediaError("broken Netpbm header")
    at += 1
    if kind == b"P4":
        row = (width + 7) // 8
        if len(data) < at + row * height:
            raise MediaError("short P4 data")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        return np.where(bits[:, :width] == 0, 255, 0).astype(np.uint8)
    sample = np.dtype(np.uint8 if top < 256 else ">u2")
    if len(data) < at + n * sample.itemsize:
        raise MediaError("short Netpbm data")
    return np.frombuffer(data, sample, n, at).reshape(shape).astype(sample.newbyteorder("="), copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; grey palettes give
    (height, width), others (height, width, 3)."""
    if len(data) < 54 or data[:2] != b"BM":
        raise MediaError("not BMP")
    start, head = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing, _, _, _, n_colours = struct.unpack_from("<iiHHIIiiI", data, 18)
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise MediaError("unsupported BMP")
    rows, pitch = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + rows * pitch:
        raise MediaError("short BMP data")
    raw = np.frombuffer(data, np.uint8, rows * pitch, start).reshape(rows, pitch)
    if height > 0:
        raw = raw[::-1]
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1])
    colours = np.frombuffer(data, np.uint8, (n_colours or 1 << bits) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        unpacked = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = (unpacked @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :width]
    if index.max(initial=0) >= len(colours):
        raise MediaError("BMP index beyond its palette")
    if np.array_equal(colours, np.repeat(colours[:, :1], 3, axis=1)):
        return np.ascontiguousarray(colours[index, 0])
    return np.ascontiguousarray(colours[index])


def decode(data: bytes) -> np.ndarray:
    """Either format, by its first bytes."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(grey: np.ndarray) -> bytes:
    """Binary 8-bit Netpbm of a (height, width) array."""
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8, copy=False).tobytes()


def encode_bmp(grey: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, bottom row first."""
    height, width = grey.shape
    pitch = (width + 3) // 4 * 4
    rows = np.zeros((height, pitch), np.uint8)
    rows[:, :width] = grey[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def luma(image: np.ndarray) -> np.ndarray:
    """Grey values as doubles from 0 to 255."""
    scale = 255.0 / 65535.0 if image.dtype == np.uint16 else 1.0
    if image.ndim == 2:
        return image * scale
    return image @ np.array([0.299, 0.587, 0.114]) * scale


def _along(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation of an integral along its first axis: exact for
    pixels of constant value."""
    low = np.minimum(at.astype(np.int64), len(total) - 2)
    part = (at - low).reshape(-1, *[1] * (total.ndim - 1))
    return total[low] * (1 - part) + total[low + 1] * part


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a height x width grid, from the integral image."""
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    ys, xs = np.linspace(0, grey.shape[0], height + 1), np.linspace(0, grey.shape[1], width + 1)
    corner = _along(_along(total, ys).T, xs).T
    return np.diff(np.diff(corner, axis=0), axis=1) / ((ys[1] - ys[0]) * (xs[1] - xs[0]))


def difference_hash(grey: np.ndarray, side: int = 8) -> str:
    """Hex of the bits "darker than the right neighbour" on a small grid."""
    small = np.round(area_resize(grey, side, side + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


@functools.lru_cache(maxsize=256)
def _npy_head(dtype: str, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": dtype, "fortran_order": False, "shape": shape})
    return out.getvalue()


def to_npy(array: np.ndarray) -> bytes:
    return _npy_head(np.lib.format.dtype_to_descr(array.dtype), array.shape) + array.tobytes()


def npy_tiles(grey: np.ndarray, tile: int) -> list[tuple[int, int, bytes]]:
    """(top, left, NPY bytes) of tiles of at most ``tile`` samples a side."""
    return [
        (y, x, to_npy(np.ascontiguousarray(grey[y : y + tile, x : x + tile])))
        for y in range(0, grey.shape[0], tile)
        for x in range(0, grey.shape[1], tile)
    ]


TILES = "media_id long, height int, width int, dhash string, top int, left int, npy binary, error string"


def media_tiles(images: DataFrame, *, media_id: str, content: str, size: tuple[int, int], tile: int) -> DataFrame:
    """Decode a binary column, area-resize to ``size`` and cut NPY tiles.

    One row per tile; null, empty and unreadable content gives one row with
    ``error`` and no tile.  Ids may repeat; other columns are ignored.
    """

    def rows(data: bytes | None):
        try:
            image = decode(data or b"")
        except (MediaError, ValueError, struct.error) as e:
            return [(None, None, None, None, None, None, str(e) or "unreadable")]
        grey = luma(image)
        small = np.clip(np.rint(area_resize(grey, *size)), 0, 255).astype(np.uint8)
        known = (image.shape[0], image.shape[1], difference_hash(grey))
        return [(*known, *t, None) for t in npy_tiles(small, tile)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in TILES.split(", ")]
        for batch in batches:
            out = [(i, *r) for i, d in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(d)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return images.select(F.col(media_id).cast("long"), F.col(content)).mapInArrow(run, TILES)


#: Samples a row of the images that payloads are stored in.
PAYLOAD_WIDTH = 64


def store_payload(payload: bytes, form: str = "pgm") -> bytes:
    """Keep bytes, a positive multiple of 64, as the samples of an image."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH)
    return encode_pgm(grey) if form == "pgm" else encode_bmp(grey)


STORED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, height int, tiles array<struct<top:int,left:int,npy:binary>>"
)
#: Samples a side of a stored text's small image, and of its tiles.
SMALL, TILE = 16, 8


def text_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", form: str = "pgm") -> DataFrame:
    """Store each text's UTF-8 bytes as an image, read it back, describe it.

    Null text counts as empty; an empty text is one row of 64 zero samples.
    ``feature`` is the image's difference hash, ``tiles`` are the NPY tiles of
    the image area-resized to 16 x 16.  Equal texts give equal values whatever
    their ids; rows are never merged, other columns are ignored, and an empty
    table gives no rows.
    """

    def describe(data: bytes):
        media = store_payload(data + bytes(-len(data) % PAYLOAD_WIDTH or (0 if data else PAYLOAD_WIDTH)), form)
        image = decode(media)
        payload = image.tobytes()
        grey = luma(image)
        small = np.clip(np.rint(area_resize(grey, SMALL, SMALL)), 0, 255).astype(np.uint8)
        return (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_WIDTH:]),
            len(media), hashlib.sha256(media).hexdigest(), difference_hash(grey), image.shape[0],
            [{"top": y, "left": x, "npy": npy} for y, x, npy in npy_tiles(small, TILE)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STORED.split(", ")]
        tile = pa.struct([("top", pa.int32()), ("left", pa.int32()), ("npy", pa.binary())])
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(tile)]
        for batch in batches:
            done = [describe(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1).cast(pa.large_binary())]
            cols = list(zip(*done, strict=True)) if done else [()] * len(types)
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, STORED)
