import io
import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest

from relayloom.llm.common import table
from relayloom.llm.media import Image, area_resize, decode, decode_bmp, difference_hash, encode_bmp, encode_pgm, media_digests, media_tiles, store_texts, tile


def overlap(size, parts):
    """How much of each of `size` unit cells lies in each of `parts` equal spans, as shares of a span."""
    a = np.arange(parts)[:, None] * size / parts
    low, high = np.arange(size), np.arange(size) + 1
    return np.clip(np.minimum(high, a + size / parts) - np.maximum(low, a), 0, None) * parts / size


def small(plane, height, width):
    return np.round(overlap(plane.shape[0], height) @ plane.astype(float) @ overlap(plane.shape[1], width).T, 6)


def feature(plane):
    """Brute force: every cell of the grid as a weighted mean of all samples."""
    eight = small(plane, 8, 9)
    bits = "".join("1" if b > a else "0" for row in eight for a, b in zip(row, row[1:]))
    out = io.BytesIO()
    np.save(out, np.rint(small(plane, 16, 16)).astype(np.uint8))
    return f"{int(bits, 2):016x}-{zlib.crc32(out.getvalue()):08x}"


def test_query_keeps_every_byte(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in media_digests(docs, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha256(stored).hexdigest())
    features = {i: feature(np.frombuffer(texts[i].encode().ljust(got[i].payload_bytes, b"\0"), np.uint8).reshape(-1, 64)) for i in texts}
    # A mean on the edge between two bytes or two equal means may fall either way.
    assert sum(features[i] == got[i].feature for i in texts) >= 0.99 * len(texts)
    images = {r.doc_id: bytes(r.data) for r in spark.read.parquet(str(tmp_path / "images")).collect()}
    tiles = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "tiles")).collect()}
    assert {i: sha256(x).hexdigest() for i, x in images.items()} == {i: r.media_sha256 for i, r in got.items()}
    for i, r in tiles.items():
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16) and got[i].feature == f"{r.dhash}-{zlib.crc32(r.tile):08x}"


@pytest.mark.parametrize("most", [1, 15, 255, 1023, 65535])
def test_white_is_white_whatever_the_largest_sample(most):
    data = b"P5\n4 4\n%d\n" % most + (most.to_bytes(2, "big") if most > 255 else bytes([most])) * 16
    image = decode(data)
    assert (np.load(io.BytesIO(tile(image.grey(), 4, image.most))) == 255).all()
    grey = decode(b"P2\n1 1\n%d\n%d" % (most, most // 3))
    assert np.load(io.BytesIO(tile(grey.grey(), 1, most)))[0, 0] == round(255 * (most // 3) / most)
    black_and_white = decode(b"P1\n2 1\n1 0")
    assert np.load(io.BytesIO(tile(black_and_white.grey(), 2, 1))).tolist() == [[0, 255]] * 2


def test_bmp_bit_fields():
    def bmp(depth, masks, body, packing=3):
        size = 54 + 12
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", size + len(body), 0, size, 40, 2, 1, 1, depth, packing, len(body), 0, 0, 0, 0) + struct.pack("<3I", *masks) + body

    blue_first = struct.pack("<2I", 0x00010203, 0x00FFFEFD)
    assert decode_bmp(bmp(32, (0xFF0000, 0xFF00, 0xFF), blue_first)).samples.tolist() == [[[1, 2, 3], [255, 254, 253]]]
    assert decode_bmp(bmp(32, (0xFF, 0xFF00, 0xFF0000), blue_first)).samples.tolist() == [[[3, 2, 1], [253, 254, 255]]]
    assert decode_bmp(bmp(16, (0xF800, 0x7E0, 0x1F), struct.pack("<2H", 0xF800, 0x7FF))).samples.tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert decode_bmp(bmp(16, (0, 0, 0), struct.pack("<2H", 0x7C00, 0x3FF), 0)).samples.tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert decode(bmp(32, (0, 0, 0), blue_first)) is None


def test_area_resize_equals_pixel_sums(monkeypatch):
    from relayloom.llm import media

    rng = np.random.default_rng(0)
    for rows, columns, height, width in ((8, 9, 8, 9), (1, 64, 8, 9), (50, 64, 8, 9), (3, 2, 16, 16), (33, 7, 5, 4)):
        plane = rng.integers(0, 256, (rows, columns), dtype=np.uint8)
        fine = np.repeat(np.repeat(plane, height, 0), width, 1).astype(float)
        want = fine.reshape(height, rows, width, columns).mean((1, 3))
        for band in (1 << 20, 64):
            monkeypatch.setattr(media, "_BAND", band)
            assert np.allclose(area_resize(plane, height, width), want)


def test_netpbm_kinds():
    assert decode(b"P1 # c\n3 2\n1 0 1\n010").samples.tolist() == [[1, 0, 1], [0, 1, 0]]
    assert decode(b"P4\n3 2\n\xa0\x40").samples.tolist() == [[1, 0, 1], [0, 1, 0]]
    assert decode(b"P2\n2 1 300\n7 300").samples.tolist() == [[7, 300]]
    assert decode(b"P5\n2 1\n300\n\0\7\1\x2c").samples.tolist() == [[7, 300]]
    assert decode(b"P3\n1 1\n255\n1 2 3").samples.tolist() == decode(b"P6\n1 1\n255\n\1\2\3").samples.tolist() == [[[1, 2, 3]]]
    assert Image(np.array([[[255, 255, 255]]], np.uint8)).grey().tolist() == [[255]]


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (4, 4), (7, 10)])
def test_bmp_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, (*shape, 3), dtype=np.uint8)
    assert (decode_bmp(encode_bmp(image)).samples == image).all()


def test_bmp_palette():
    head = b"BM" + b"\0" * 8 + (54 + 16).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0\4\0" + b"\0" * 24
    colours = bytes([0, 0, 0, 0, 1, 2, 3, 0, 4, 5, 6, 0, 7, 8, 9, 0])
    assert decode(head + colours + b"\x12\x30\0\0").samples.tolist() == [[[3, 2, 1], [6, 5, 4], [9, 8, 7]]]


def test_tiles_and_broken_media(spark):
    plane = np.arange(64 * 9, dtype=np.uint16).reshape(-1, 64).astype(np.uint8)
    rows = [(1, encode_pgm(plane)), (2, b""), (3, None), (4, b"P5\n9 9\n255\nxx"), (5, b"BM"), (None, encode_pgm(plane)), (6, b"P9 1 1 1 1"), (7, b"P5\n0 3\n255\n")]
    got = {r.media_id: r for r in media_tiles(spark.createDataFrame([(*r, "x") for r in rows], "media_id long, data binary, tile string")).collect()}
    assert np.load(io.BytesIO(got[1].tile)).shape == (16, 16) and got[1].dhash == f"{difference_hash(plane):016x}"
    assert got[None].tile == got[1].tile == tile(plane)
    assert all(got[i].tile is None and got[i].dhash is None for i in (2, 3, 4, 5, 6, 7))


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    got = media_digests(odd_docs, str(tmp_path / "a")).collect()
    assert len(got) == odd_docs.count() and media_digests(no_docs, str(tmp_path / "b")).count() == 0 == store_texts(no_docs).count()
    by = {r.doc_id: tuple(r)[1:] for r in got}
    assert by[3] == by[4] and by[3][:2] == (0, 64)
    assert {r.doc_id: decode(r.data).samples.tobytes()[: r.n_bytes] for r in store_texts(odd_docs).collect()}[7].decode().startswith("Ünïcode")
