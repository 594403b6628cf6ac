"""Operator 1: media columns.

Netpbm (P1 to P6) and uncompressed BMP bytes are decoded to numpy arrays, resized by
area with integral images, and written as NPY tiles with difference hashes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_map

_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) of uint8 or, for a maximum above 255, uint16. Bitmaps become 0 and 255; other samples keep
    their values, and one beyond the stated maximum, like a maximum outside 1 to 65535 or a plain bit that is none, is an error."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, colour = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (width, height, *most), at = _numbers(data, 2, 2 if bitmap else 3)
    shape = (height, width, 3) if colour == 3 else (height, width)
    n = width * height * colour
    if kind == b"P4":
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        return ((1 - np.unpackbits(bits, axis=1)[:, :width]) * 255).astype(np.uint8)
    if most and not 1 <= most[0] <= 65535:
        raise ValueError("bad stated maximum")
    wide = bool(most) and most[0] > 255
    if kind in (b"P5", b"P6"):
        values = np.frombuffer(data, ">u2" if wide else np.uint8, n, at + 1).reshape(shape)
        if most[0] not in (255, 65535) and values.size and values.max() > most[0]:
            raise ValueError("a sample is beyond the stated maximum")
        return values.astype(np.uint16 if wide else np.uint8, copy=False)
    body = re.sub(rb"#[^\n]*", b"", data[at:])
    if kind == b"P1":
        values = np.frombuffer(re.sub(rb"\s", b"", body), np.uint8)[:n]
        if not np.isin(values, (48, 49)).all():
            raise ValueError("a bit is neither 0 nor 1")
        values = values - 48
        return ((1 - values) * 255).astype(np.uint8).reshape(shape)
    values = np.array(body.split()[:n], dtype=np.int64).reshape(shape)
    if values.size and not 0 <= values.min() <= values.max() <= min(most[0], 65535):
        raise ValueError("a sample is beyond the stated maximum")
    return values.astype(np.uint16 if wide else np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width) for grey palettes, else (height, width, 3); 8, 24 and 32 bits, uncompressed. Masks of 32 bits may order the channels
    anyhow, each a whole byte."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start = struct.unpack_from("<I", data, 10)[0]
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32) or packed == 3 and bits != 32 or width < 0:
        raise ValueError("unsupported BMP")
    places = [2, 1, 0]
    if packed == 3:
        places = [{0xFF << 8 * i: i for i in range(4)}.get(mask, -1) for mask in struct.unpack_from("<III", data, 54)]
        if -1 in places:
            raise ValueError("unsupported BMP masks")
    rows, row = abs(height), (width * bits // 8 + 3) // 4 * 4
    grid = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)[:, : width * bits // 8]
    grid = grid[::-1] if height > 0 else grid
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        colours = np.zeros((256, 3), np.uint8)
        colours[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
        out = colours[grid]
        return out[..., 0] if (colours == colours[:, :1]).all() else out
    return np.ascontiguousarray(grid.reshape(rows, width, bits // 8)[..., places])


def decode_media(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(grid: np.ndarray) -> bytes:
    height, width = grid.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(grid, np.uint8).tobytes()


def area_resize(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, by an integral image; cells may be fractions of a sample."""
    grey = grid.mean(axis=2) if grid.ndim == 3 else grid
    rows, cols = grey.shape
    total = np.zeros((rows + 1, cols + 1))
    total[1:, 1:] = grey.cumsum(0, dtype=np.float64).cumsum(1)

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * n / parts
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (y, fy), (x, fx) = edges(rows, height), edges(cols, width)
    lines = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    at = lines[:, x] * (1 - fx) + lines[:, x + 1] * fx
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return cells * (height * width / (rows * cols))


def difference_hash(grid: np.ndarray, size: int = 8) -> str:
    """size*size bits in hex: whether each resized sample is darker than its right neighbour."""
    small = np.round(area_resize(grid, size, size + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_bytes(grid: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(grid), allow_pickle=False)
    return out.getvalue()


def tiles(grid: np.ndarray, rows: int, cols: int) -> list[tuple[int, int, bytes, str]]:
    """(row, col, NPY bytes, difference hash) of each tile, from the top left."""
    return [
        (y // rows, x // cols, npy_bytes(part := grid[y : y + rows, x : x + cols]), difference_hash(part))
        for y in range(0, grid.shape[0], rows)
        for x in range(0, grid.shape[1], cols)
    ]


#: What decoding a broken image can raise.
BROKEN = (ValueError, IndexError, OverflowError, MemoryError, struct.error)


def _fields(df: DataFrame, id_col: str, others: str) -> StructType:
    """A schema of ``id``, of whatever type, and others."""
    return StructType([StructField("id", df.schema[id_col].dataType), *StructType.fromDDL(others)])


def media_tiles(df: DataFrame, id_col: str = "media_id", media_col: str = "media", tile_rows: int = 1024, tile_cols: int = 1024) -> DataFrame:
    """(id, tile_row, tile_col, npy, dhash, error): one row per tile of each Netpbm or BMP value.

    A null, empty or broken value, or one without samples, gives one row with null tile columns and the reason in ``error``.
    Repeated rows give repeated tiles; an empty table gives an empty result; other
    columns are not read. Tiles are written by the table's own sink.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if not data:
                        raise ValueError("no media")
                    parts = tiles(decode_media(data), tile_rows, tile_cols)
                    if not parts:
                        raise ValueError("no samples")
                    out += [(key, *p, None) for p in parts]
                except BROKEN as e:
                    out.append((key, None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "tile_row", "tile_col", "npy", "dhash", "error"])

        return step

    schema = _fields(df, id_col, "tile_row int, tile_col int, npy binary, dhash string, error string")
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), make, schema, rows=16).withColumnRenamed("id", id_col)


#: Samples in a row of a text's raster.
TEXT_WIDTH = 64


def text_raster(text: str | None) -> bytes:
    """A text's bytes, padded with zeros to a positive multiple of 64, as a grey Netpbm image 64 samples wide."""
    data = (text or "").encode()
    data += b"\0" * (-len(data) % TEXT_WIDTH or (0 if data else TEXT_WIDTH))
    return encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, TEXT_WIDTH))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): every text stored losslessly as a grey Netpbm image.

    A null or empty text becomes one row of 64 zero samples. Repeated rows give repeated images, texts of any length are
    stored whole, an empty table gives an empty result; other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([text_raster(t) for t in texts], pa.binary())],
                ["id", "n_bytes", "media"],
            )

        return step

    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, _fields(df, id_col, "n_bytes long, media binary"), rows=64).withColumnRenamed("id", id_col)


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile_rows: int = 4096) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_tiles, tiles_sha256, error).

    Each stored image is decoded, cut into NPY tiles and read back from them; the payload
    columns describe the bytes that come back. ``feature`` is the hash of the whole image
    followed by those of its tiles where it has several. ``tiles_sha256`` is of the tiles' NPY bytes in order.
    A null, empty or broken image, or one without samples, gives null features and the reason in ``error``. Repeated rows
    give repeated features, images of any size are read whole, an empty table gives an empty result; other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for key, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    grid = decode_media(media or b"")
                    parts = tiles(grid, tile_rows, max(1, grid.shape[1]))
                    if not parts:
                        raise ValueError("no samples")
                except BROKEN as e:
                    out.append((key, n, *[None] * 8, str(e)))
                    continue
                back = b"".join(np.load(io.BytesIO(p[2]), allow_pickle=False).tobytes() for p in parts)
                sha = hashlib.sha256()
                for p in parts:
                    sha.update(p[2])
                whole = parts[0][3] if len(parts) == 1 else ".".join([difference_hash(grid), *(p[3] for p in parts)])
                out.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), whole, len(parts), sha.hexdigest(), None))
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256", "error"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        return step

    schema = _fields(df, id_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int, tiles_sha256 string, error string")
    return arrow_map(df.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media")), make, schema, rows=64).withColumnRenamed("id", id_col)
