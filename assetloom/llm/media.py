"""Media columns: Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays (height, width, channels) of bytes, shrunk by area averages that
an integral image gives in constant time a cell, and kept as NPY tiles of one size together with a
difference hash of the grey image.

Defined results: null or empty bytes make the smallest image, a single padded row; equal bytes give
equal images, tiles and hashes; bytes that are no image of the three formats raise ValueError.
"""

from __future__ import annotations

import io
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import per_text, table

#: Pixels and bytes of a row: 64 pixels of three channels.
WIDTH, ROW = 64, 192
#: Side of the stored tiles, and the grey grid of the difference hash (rows, columns).
TILE, HASH_GRID = 16, (8, 9)


def padded(data: bytes) -> bytes:
    """The bytes, with spaces up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def encode_image(pixels: np.ndarray, form: str) -> bytes:
    """An image file; form is ``ppm`` or ``bmp`` (three channels) or ``pgm`` (one)."""
    h, w, channels = pixels.shape
    if form in ("ppm", "pgm"):
        if channels != (3 if form == "ppm" else 1):
            raise ValueError(f"{form} with {channels} channels")
        return b"%s\n%d %d\n255\n" % (b"P6" if form == "ppm" else b"P5", w, h) + pixels.tobytes()
    if form != "bmp" or channels != 3:
        raise ValueError(f"{form} with {channels} channels")
    stride = -(-3 * w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)  # from the bottom, blue first
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


#: Magic number, width, height and largest sample, apart by white space or comments, then one byte.
NETPBM = re.compile(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def decode_image(data: bytes) -> np.ndarray:
    """The pixels (height, width, channels) of a Netpbm (P5, P6) or BMP (24 bit) file."""
    if data[:2] == b"BM":
        start, = struct.unpack_from("<I", data, 10)
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        if bits != 24 or packing:
            raise ValueError("only plain BMP of 24 bits")
        stride = -(-3 * w // 4) * 4
        rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
        return np.ascontiguousarray(rows[::-1] if h > 0 else rows)
    m = NETPBM.match(data)
    if m is None or int(m[4]) != 255:
        raise ValueError("neither BMP nor Netpbm of 8 bits")
    w, h, channels = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    return np.frombuffer(data, np.uint8, h * w * channels, m.end()).reshape(h, w, channels)


def integral_image(pixels: np.ndarray) -> np.ndarray:
    """(height + 1, width + 1, channels): the sums of all pixels above and left of each corner."""
    h, w, channels = pixels.shape
    total = np.zeros((h + 1, w + 1, channels), np.int64)
    inner = total[1:, 1:]
    np.cumsum(pixels, axis=0, dtype=np.int64, out=inner)
    np.cumsum(inner, axis=1, out=inner)
    return total


def cell_means(total: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area averages on a grid of rows x columns, as float64 (rows, columns, channels).

    The integral image is read between its points by linear interpolation, which is exact for
    pixels of constant colour, so cells need not end at pixel borders.
    """
    h, w = total.shape[0] - 1, total.shape[1] - 1

    def at(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), len(values) - 2)
        part = (edges - low).reshape(-1, 1, 1)
        return values[low] * (1 - part) + values[low + 1] * part

    y, x = np.linspace(0, h, rows + 1), np.linspace(0, w, columns + 1)
    corners = at(x, at(y, total).swapaxes(0, 1)).swapaxes(0, 1)
    return np.diff(np.diff(corners, axis=0), axis=1) / (h / rows * w / columns)


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """An image shrunk or stretched to rows x columns by area averages, as float64."""
    return cell_means(integral_image(pixels), rows, columns)


def difference_hash(total: np.ndarray) -> str:
    """64 bits in hex, of an integral image: whether each cell of the grey grid is brighter than the
    one to its left."""
    grey = cell_means(total, *HASH_GRID).mean(axis=2)
    return np.packbits(np.diff(grey, axis=1) > 1e-6).tobytes().hex()


def npy_tile(total: np.ndarray, side: int = TILE) -> bytes:
    """The image of an integral image, shrunk or stretched to side x side, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(cell_means(total, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


@lru_cache(maxsize=4)
def _store(form: str):
    def run(data) -> bytes:
        data = padded(data.encode() if isinstance(data, str) else data)
        return encode_image(np.frombuffer(data, np.uint8).reshape(-1, WIDTH, ROW // WIDTH), form)

    return run


READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType())])


@lru_cache(maxsize=1)
def _load():
    def run(media: bytes) -> dict:
        pixels = decode_image(media)
        total = integral_image(pixels)
        return {"payload": pixels.tobytes(), "tile": npy_tile(total), "dhash": difference_hash(total)}

    return run


def store_media(data: Column, form: str = "ppm") -> Column:
    """A text or binary column as images of 64 pixels a row."""
    return per_text(_store, T.BinaryType(), form)(data)


def read_media(media: Column) -> Column:
    """struct(payload: the samples in row order, tile: NPY bytes, dhash: 16 hex digits)."""
    return per_text(_load, READ)(media)


def op4_media_columns(spark, sf_dir):
    """Store every text as an image, read it back, and describe both."""
    stored = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), store_media(F.col("text")).alias("media"))
    read = stored.select("*", read_media(F.col("media")).alias("r"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("r.payload").cast("long").alias("payload_bytes"),
        F.sha2("r.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("r.payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("r.dhash").alias("feature"),
        F.sha2("r.tile", 256).alias("tile_sha256"),
    )
