"""Media columns: Netpbm and BMP bytes as numpy arrays, small tiles, and hashes of their looks.

Binary and plain PBM, PGM and PPM files (P1 to P6; samples of 8 or 16 bits) and uncompressed BMP files (1, 4, 8, 16, 24
or 32 bits a pixel, bit fields of any masks) are decoded to arrays. An image is resized by area: integral images give
the sum over any rectangle from four values, and a target pixel is the mean over the
rectangle it covers, borders in part. The sums run over bands of rows, so memory stays
bounded for tall images. Tiles are NPY files, their samples scaled so that the file's largest sample is 255; difference
hashes compare neighbours in a row of a 9 x 8 tile.

`store_texts` keeps any text as such an image, without loss: its UTF-8 bytes, zeros up to a
positive multiple of 64, as a binary PGM 64 samples wide. `media_digests` writes these images to files (a Parquet
folder, a row an image, as all writes that a cluster may lose a task of), reads them back, writes their tiles and
hashes, and reads these back. Two scans; no shuffle.

Defined cases: a null text is empty (64 zeros); null, empty or broken media give null
arrays, tiles and hashes, never an error; repeated rows each get a row; equal bytes give
equal values; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import chunks, map_texts

WIDTH = 64
_BAND = 1 << 20  # samples of a band of rows


def encode_pgm(samples: np.ndarray) -> bytes:
    """A two-dimensional array of bytes as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


@dataclass(frozen=True)
class Image:
    """Height x width (x 3) samples as in the file, and the sample that is white (bright, for colours): 0 in bitmaps."""

    samples: np.ndarray
    most: int = 255
    bitmap: bool = False

    def grey(self) -> np.ndarray:
        """One plane of brightness, 0 to `most`: of three, their integer luma."""
        if self.bitmap:
            return 1 - self.samples
        if self.samples.ndim == 2:
            return self.samples
        return (self.samples.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000


def decode_netpbm(data: bytes) -> Image:
    """Bits are 0 for white and 1 for black, as in the file."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    fields, at = [], 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)").match(data, at)
        if m is None:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = (*fields, 1)[:3]
    if not 0 < most < 65536 or not width or not height:
        raise ValueError("broken Netpbm header")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    sample = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
    if kind == b"P1":
        body = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])
        return Image((np.frombuffer(body, np.uint8, count) - 48).reshape(shape), 1, True)
    if kind in (b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:]).split(None, count)[:count]
        return Image(np.array(body, np.int64).astype(sample.newbyteorder("=")).reshape(shape), most)
    if kind == b"P4":
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        return Image(np.unpackbits(packed, axis=1)[:, :width], 1, True)
    return Image(np.frombuffer(data, sample, count, at + 1).reshape(shape), most)


def _fields(raw: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """Samples of 8 bits from the bits of each mask, scaled to 255."""
    planes = []
    for mask in masks:
        if not mask:
            raise ValueError("empty bit field")
        low = (mask & -mask).bit_length() - 1
        most = mask >> low
        planes.append(((raw & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 // most)
    return np.stack(planes, 2).astype(np.uint8)


def decode_bmp(data: bytes) -> Image:
    """Red first, top row first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    offset, head, width, height, _, depth, packing = struct.unpack_from("<10xIIiiHHI", data)
    down, height = height < 0, abs(height)
    fields = packing in (3, 6)
    if packing not in (0, 3, 6) or (fields and depth not in (16, 32)) or width <= 0 or not height or depth not in (1, 4, 8, 16, 24, 32):
        raise ValueError("not an uncompressed BMP")
    row = -(-width * depth // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * height, offset).reshape(height, row)
    if fields or depth == 16:
        # The masks follow a header of 40 bytes, or are part of a longer one: at the same place.
        masks = struct.unpack_from("<3I", data, 54) if fields else (0x7C00, 0x3E0, 0x1F)
        out = _fields(raw.view("<u2" if depth == 16 else "<u4")[:, :width].astype(np.uint32), masks)
    elif depth >= 24:
        out = raw[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1]
    else:
        colours = np.frombuffer(data, np.uint8, min((offset - 14 - head) // 4, 1 << depth) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        index = raw if depth == 8 else np.unpackbits(raw, axis=1) if depth == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(height, -1)
        out = colours[index[:, :width]]
    return Image(out if down else out[::-1])


def encode_bmp(samples: np.ndarray) -> bytes:
    """Height x width x 3 bytes as a 24-bit BMP."""
    height, width = samples.shape[:2]
    row = -(-width * 3 // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + body.size, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode(data: bytes | None) -> Image | None:
    """A Netpbm or BMP file; None for anything else or what is cut short."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (TypeError, ValueError, IndexError, struct.error):
        return None


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * size / parts
    whole = np.minimum(at.astype(np.int64), size)
    return whole, at - whole


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the rectangles of a height x width grid (double)."""
    rows, columns = plane.shape
    row, row_part = _edges(rows, height)
    column, column_part = _edges(columns, width)
    at_row = np.zeros((height + 1, width + 1))  # integral image at the grid's corners
    total, step = np.zeros(width + 1), max(1, _BAND // columns)
    for first in range(0, rows, step):
        band = plane[first : first + step]
        sums = np.zeros((len(band), columns + 1), np.int64)
        np.cumsum(band, axis=1, dtype=np.int64, out=sums[:, 1:])
        inner = sums[:, column] + column_part * (sums[:, np.minimum(column + 1, columns)] - sums[:, column])
        integral = np.vstack([total, total + np.cumsum(inner, axis=0)])
        last = first + len(band)
        for k in np.flatnonzero((row >= first) & (row < last)):
            at_row[k] = integral[row[k] - first] + row_part[k] * (integral[row[k] - first + 1] - integral[row[k] - first])
        total = integral[-1]
    at_row[row == rows] = total
    area = (rows / height) * (columns / width)
    return np.diff(np.diff(at_row, axis=0), axis=1) / area


def difference_hash(plane: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 neighbours to the right is brighter."""
    small = np.round(area_resize(plane, 8, 9), 6)
    return int.from_bytes(np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile(plane: np.ndarray, side: int = 16, most: int = 255) -> bytes:
    """A side x side NPY tile of bytes, where `most` becomes 255."""
    small = area_resize(plane, side, side) * (255 / most)
    return npy(np.clip(np.rint(np.round(small, 6)), 0, 255).astype(np.uint8))


_TILES = "height int, width int, tile binary, dhash string"


def _tile(image: Image | None, side: int) -> tuple:
    if image is None:
        return (None,) * 4
    plane = image.grey()
    return *plane.shape, tile(plane, side, image.most), f"{difference_hash(plane):016x}"


def media_tiles(media: DataFrame, side: int = 16) -> DataFrame:
    """media_id, height, width, tile (NPY) and dhash (16 hex digits) of rows (media_id, data)."""
    out = media.sparkSession.createDataFrame([], f"media_id long, {_TILES}").schema
    rows = media.select(F.col("media_id").cast("long"), F.col("data").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            made = [_tile(decode(data), side) for data in part.column("data").to_pylist()]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("media_id"), *(pa.array([m[k] for m in made], t) for k, t in enumerate(types))], names=out.names)

    return rows.mapInArrow(run, out)


def pack(text: str) -> tuple[bytes, int]:
    """The stored form of a text, and its length in UTF-8."""
    raw = text.encode()
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return encode_pgm(np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)), len(raw)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and data: each text as a binary PGM."""

    def made(texts: list[str]) -> dict[str, list]:
        packed = [pack(t) for t in texts]
        return {"n_bytes": [p[1] for p in packed], "data": [p[0] for p in packed]}

    return map_texts(docs, made, "n_bytes long, data binary")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def describe(stored: DataFrame, side: int = 16) -> DataFrame:
    """Digests of stored images (doc_id, n_bytes, data) and of the payloads that they decode to, with their tiles and hashes."""
    out = stored.sparkSession.createDataFrame([], f"{_DIGESTS}, {_TILES}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for part in chunks(batches):
            rows = []
            for doc_id, size, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "data"))):
                image = decode(data)
                payload = image.samples.tobytes()
                rows.append((doc_id, size, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), sha256(data).hexdigest(), *_tile(image, side)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return stored.select("doc_id", "n_bytes", "data").mapInArrow(run, out)


def media_digests(docs: DataFrame, folder: str) -> DataFrame:
    """Store, read back and describe: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (difference hash and CRC-32 of the NPY tile); images and tiles are in folder."""
    spark = docs.sparkSession
    store_texts(docs).write.option("compression", "zstd").parquet(f"{folder}/images")
    describe(spark.read.parquet(f"{folder}/images")).write.option("compression", "zstd").parquet(f"{folder}/tiles")
    feature = F.concat("dhash", F.lit("-"), F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0"))
    return spark.read.parquet(f"{folder}/tiles").select(*[c.split()[0] for c in _DIGESTS.split(", ")], feature.alias("feature"))
