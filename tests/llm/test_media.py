import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmix.llm import media as M


def bmp(grid):
    h, w = grid.shape[:2]
    row = (w * 3 + 3) // 4 * 4
    body = b"".join(grid[y, :, ::-1].tobytes().ljust(row, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_decoders():
    rng = np.random.default_rng(0)
    grey, rgb = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    assert (M.decode_media(M.encode_pgm(grey)) == grey).all()
    assert (M.decode_media(b"P2 # c\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (M.decode_media(b"P6\n3 4\n255\n" + rgb.tobytes()) == rgb).all()
    assert (M.decode_media(b"P3\n3 4 255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert (M.decode_media(bmp(rgb)) == rgb).all()
    bits = rng.integers(0, 2, (3, 10), np.uint8)
    assert (M.decode_media(b"P1\n10 3\n" + " ".join(map(str, bits.ravel())).encode()) == (1 - bits) * 255).all()
    assert (M.decode_media(b"P4\n10 3\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    wide = rng.integers(0, 60000, (2, 2)).astype(">u2")
    assert (M.decode_media(b"P5\n2 2\n60000\n" + wide.tobytes()) == wide).all()


def test_area_resize_is_a_mean():
    grid = np.arange(48, dtype=float).reshape(6, 8)
    assert np.allclose(M.area_resize(grid, 3, 4), grid.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(M.area_resize(grid, 1, 1), grid.mean())
    assert np.allclose(M.area_resize(grid, 6, 8), grid)
    assert np.allclose(M.area_resize(np.full((2, 3), 7.0), 8, 9), 7)


def test_text_payloads(spark):
    texts = [None, "", "a", "x" * 64, "é" * 5000, "x" * 64]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("z", "z")
    got = {r.doc_id: r for r in M.media_features(M.text_media(rows), tile_rows=32).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(pay))
        assert r.payload_sha256 == hashlib.sha256(pay).hexdigest()
        assert r.tail_crc32 == zlib.crc32(pay[-64:])
    same = lambda r: r[1:]
    assert same(got[3]) == same(got[5]) and same(got[0]) == same(got[1])
    assert M.media_features(M.text_media(rows.limit(0))).count() == 0


def test_tiles_and_broken_values(spark):
    grid = np.arange(50 * 30, dtype=np.uint8).reshape(50, 30)
    rows = spark.createDataFrame([(1, M.encode_pgm(grid), 0), (2, b"junk", 0), (3, None, 0), (4, b"P5\n9 9\n255\nxx", 0)], "media_id long, media binary, npy int")
    got = M.media_tiles(rows, tile_rows=20, tile_cols=16).collect()
    mine = [r for r in got if r.media_id == 1]
    assert len(mine) == 6
    back = np.block([[np.load(io.BytesIO(next(r.npy for r in mine if (r.tile_row, r.tile_col) == (y, x)))) for x in range(2)] for y in range(3)])
    assert (back == grid).all()
    assert {r.media_id for r in got if r.error} == {2, 3, 4}


@pytest.mark.parametrize("data", [b"", b"P9\n", b"BM"])
def test_bad_bytes(data):
    with pytest.raises((ValueError, struct.error)):
        M.decode_media(data)


def test_broken_headers_are_reported(spark):
    bad = [b"P5 99999999999 99999999999 255\n", b"P2 1 1 255 99999999999999999999", b"P2 2 1 44 300 1", b"P2 1 1 255 -3", b"P5 2 2 255\nx", b"BM", b"zz"]
    rows = M.media_tiles(spark.createDataFrame(list(enumerate(bad)), "media_id int, media binary")).collect()
    assert len(rows) == len(bad) and all(r.error and r.npy is None for r in rows)
    assert M.media_tiles(spark.createDataFrame([], "media_id int, media binary")).count() == 0
    assert M.decode_media(b"P2 2 1 44 44 1").tolist() == [[44, 1]]


def test_feature_against_plain_means(spark):
    text = "".join(chr(33 + i * i % 90) for i in range(64 * 9 * 8))
    row = M.media_features(M.text_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    grid = np.frombuffer(text.encode(), np.uint8).reshape(-1, 64).astype(float)
    cells = np.array([[grid[y * 9 : y * 9 + 9, :].repeat(9, 1)[:, x * 64 : x * 64 + 64].mean() for x in range(9)] for y in range(8)])
    assert row.feature == np.packbits(np.round(cells, 6)[:, :-1] < np.round(cells, 6)[:, 1:]).tobytes().hex()
    stored = M.text_raster(text)
    assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and row.n_tiles == 1


@pytest.mark.parametrize(
    "data",
    [
        b"P1\n2 1\n0 7",
        b"P5\n2 1\n100\n" + bytes([5, 101]),
        b"P5\n1 1\n0\n\0",
        b"P5\n1 1\n70000\n\0\0",
        struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 58, 0, 0, 54, 40, -1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0",
        struct.pack("<2sIHHIIiiHHIIiiIIIII", b"BM", 70, 0, 0, 66, 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0, 0xFFF, 0xFF00, 0xFF0000) + b"\1\2\3\0",
    ],
)
def test_samples_out_of_bounds_and_odd_masks_are_errors(data):
    with pytest.raises(M.BROKEN):
        M.decode_media(data)


def test_masks_order_the_channels():
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 70, 0, 0, 66, 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0)
    for masks, want in (((0xFF, 0xFF00, 0xFF0000), [1, 2, 3]), ((0xFF0000, 0xFF00, 0xFF), [3, 2, 1])):
        assert M.decode_bmp(head + struct.pack("<III", *masks) + b"\1\2\3\0").tolist() == [[want]]


def test_features_of_null_and_broken_media(spark):
    good = M.text_raster("hello")
    rows = [((1, "a b"), None), ((2, "x"), b""), ((3, "x"), b"P5\n9 9\n255\n\0"), ((4, "x"), good), ((4, "x"), good), ((5, "x"), b"P5\n0 3\n255\n")]
    df = spark.createDataFrame([(k, 7, m, "z") for k, m in rows], "key struct<`an id`: int, name: string>, n_bytes long, media binary, feature string")
    out = M.media_features(df, id_col="key")
    got = {}
    for r in out.collect():
        got.setdefault(r.key[0], []).append(r)
    assert [len(got[i]) for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 2, 1]
    assert all(r.feature is None and r.payload_sha256 is None and r.error for i in (1, 2, 3, 5) for r in got[i])
    assert got[4][0] == got[4][1] and got[4][0].payload_bytes == 64 and got[4][0].error is None
    assert M.media_features(df.limit(0), id_col="key").collect() == []
    assert M.text_media(df.select("key", F.lit(None).cast("string").alias("text"), "feature"), id_col="key").filter("n_bytes = 0").count() == len(rows)
