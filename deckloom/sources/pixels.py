"""Pixel features of images, in Arrow batches, once for each distinct image."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from deckloom.functions.images import image_class
from deckloom.schema import IMAGE_FEATURES
from deckloom.sources.convert import convert_vector

#: Longer sides are scaled down to this before features are taken.
MAX_SIDE = 256
NOT_GREY = 40
EDGE = 30


def _png(data: bytes) -> tuple[np.ndarray, bool]:
    """RGBA pixels of a PNG without interlacing, and whether it has alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not PNG")
    at, body, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise ValueError("truncated PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("PNG without a header")
    width, height, depth, colour, _, _, interlace = head
    if interlace or not width or not height:
        raise ValueError("unsupported PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    pitch, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) < height * (pitch + 1):
        raise ValueError("short PNG data")
    lines = np.zeros((height, pitch), np.uint8)
    above = np.zeros(pitch, np.uint8)
    for y in range(height):
        kind, line = raw[y * (pitch + 1)], raw[y * (pitch + 1) + 1 : (y + 1) * (pitch + 1)].copy()
        if kind == 2:
            line += above
        elif kind:
            up, own = above.tolist(), line.tolist()
            for x in range(pitch):
                left = own[x - step] if x >= step else 0
                corner = up[x - step] if x >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = left if a <= b and a <= c else up[x] if b <= c else corner
                own[x] = (own[x] + guess) & 255
            line = np.array(own, np.uint8)
        lines[y] = above = line
    if depth == 16:
        values = lines.reshape(height, width, channels, 2)[..., 0]
    elif depth == 8:
        values = lines.reshape(height, width, channels)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth)[::-1])
        values = bits[:, :width, None].astype(np.uint8)
        if colour == 0:
            values = values * (255 // ((1 << depth) - 1))
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None:
            raise ValueError("PNG without its palette")
        out[..., :3] = palette[values[..., 0]]
        if alpha:
            table = np.full(256, 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            out[..., 3] = table[values[..., 0]]
    else:
        out[..., :3] = values[..., :3] if channels >= 3 else values[..., :1]
        if channels in (2, 4):
            out[..., 3] = values[..., -1]
    return out, colour in (4, 6)


def _decode(data: bytes) -> tuple[np.ndarray, bool]:
    """RGBA pixels no longer than the limit; Pillow, where it is installed,
    reads all formats, else only PNG is read and large ones are averaged down."""
    try:
        from PIL import Image
    except ImportError:
        pixels, has_alpha = _png(data)
        height, width = pixels.shape[:2]
        scale = max(height, width) / MAX_SIDE
        if scale > 1:
            size = (max(1, round(height / scale)), max(1, round(width / scale)))
            rows, cols = (np.linspace(0, n, k + 1) for n, k in zip((height, width), size, strict=True))
            total = np.zeros((height + 1, width + 1, 4))
            total[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
            pick = total[rows.round().astype(int)][:, cols.round().astype(int)]
            area = np.diff(rows.round())[:, None, None] * np.diff(cols.round())[None, :, None]
            pixels = np.rint(np.diff(np.diff(pick, axis=0), axis=1) / np.maximum(area, 1)).astype(np.uint8)
        return pixels, has_alpha
    image = Image.open(io.BytesIO(data))
    image.load()
    has_alpha = image.mode in ("RGBA", "LA", "PA")
    image = image.copy()
    image.thumbnail((MAX_SIDE, MAX_SIDE), Image.Resampling.LANCZOS)
    return np.asarray(image.convert("RGBA")), has_alpha


def features(data: bytes) -> dict | None:
    """The features of an image; null where it cannot be decoded."""
    try:
        pixels, has_alpha = _decode(data)
    except Exception:
        return None
    height, width = pixels.shape[:2]
    total = width * height
    packed = np.ascontiguousarray(pixels).view(np.uint32).ravel()
    _, counts = np.unique(packed, return_counts=True)
    rgb = pixels[..., :3].astype(np.int64)
    colourful = (rgb.max(axis=2) - rgb.min(axis=2) >= NOT_GREY).sum()
    luma = (rgb @ np.array([299, 587, 114])) // 1000
    edge = np.zeros(luma.shape, bool)
    edge[:, :-1] |= np.abs(np.diff(luma, axis=1)) >= EDGE
    edge[:-1] |= np.abs(np.diff(luma, axis=0)) >= EDGE
    return {
        "width": width, "height": height, "aspect_ratio": width / height, "n_unique_colors": len(counts),
        "color_fraction": float(colourful / total), "edge_density": float(edge.sum() / total),
        "bg_fraction": float(counts.max() / total), "has_alpha": has_alpha,
    }


def image_features(images: DataFrame, *, content: str = "image_bytes", extension: str = "image_ext") -> DataFrame:
    """(hash, extension, features) of the distinct images of a table; vector
    images are converted first where that is possible."""
    schema = f"hash STRING, extension STRING, features {IMAGE_FEATURES}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, ext, data in batch.itertuples(index=False):
                raw = bytes(data)
                if ext in ("emf", "wmf"):
                    raw = convert_vector(raw, ext) or b""
                out.append((key, ext, features(raw) if raw else None))
            yield pd.DataFrame(out, columns=["hash", "extension", "features"])

    some = images.where(F.length(content) > 0).select(
        F.sha2(content, 256).alias("hash"), F.lower(F.coalesce(extension, F.lit(""))).alias("extension"), F.col(content).alias("content")
    )
    return some.dropDuplicates(["hash", "extension"]).mapInPandas(run, schema)


#: Images whose features a task remembers, so that a copy is decoded once there.
REMEMBERED = 256


def classify_images(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``classification`` filled for images; others keep theirs.

    Images are measured where they are, so that their bytes move nowhere; an
    image that cannot be decoded keeps its class too.
    """
    known = StructType.fromDDL(IMAGE_FEATURES.removeprefix("STRUCT<").removesuffix(">"))
    rows = shapes.where(F.col("kind") == "image").select(F.struct("*").alias("row"))
    schema = StructType([*rows.schema.fields, StructField("features", known)])
    at = [shapes.columns.index(c) for c in ("image_bytes", "image_ext")]
    features_type = to_arrow_type(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=REMEMBERED)
        def measured(data: bytes, extension: str) -> dict | None:
            raw = convert_vector(data, extension) if extension in ("emf", "wmf") else data
            return features(raw) if raw else None

        for batch in batches:
            images, extensions = (batch.column(0).field(i).to_pylist() for i in at)
            found = [measured(x, (e or "").lower()) if x else None for x, e in zip(images, extensions, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, features_type)], ["row", "features"])

    done = rows.mapInArrow(run, schema).select("row.*", image_class(F.col("features")).alias("__found"))
    done = done.withColumn("classification", F.coalesce("__found", "classification")).select(*shapes.columns)
    return shapes.where(~F.coalesce(F.col("kind") == "image", F.lit(False))).unionByName(done)
