"""Media columns: byte payloads as Netpbm or BMP images, decoded to arrays, area-resized, with difference hashes.

A payload is a positive multiple of 576 bytes; it becomes a grey Netpbm image 576 wide, or a colour Netpbm or BMP image 192 wide, as
its checksum says. Decoders read binary Netpbm (P5, P6; 8 bits, comments allowed) and uncompressed 24-bit or 8-bit grey BMP (bottom-up
or top-down, padded rows). Area resizing reads box sums off an integral image with fractional edges. Tiles are NPY files.

Null texts are empty: one row of padding.
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

from veilspark.llm.common import map_arrow, materialise

#: Payload bytes come in rows of this size, filled up with this byte.
ROW, FILL = 576, 255
#: Edge of a tile, and rows of an image that are resized at once.
TILE, STRIPE = 16, 4096
_HEADER = re.compile(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def payload_of(data: bytes) -> bytes:
    """Data, filled up to a positive multiple of ROW."""
    return data + bytes([FILL]) * (-len(data) % ROW if data else ROW)


def encode_image(payload: bytes) -> bytes:
    """The image that stores a payload."""
    height = len(payload) // ROW
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        return b"P5\n%d %d\n255\n" % (ROW, height) + payload
    if kind == 1:
        return b"P6\n%d %d\n255\n" % (ROW // 3, height) + payload
    return encode_bmp(np.frombuffer(payload, np.uint8).reshape(height, ROW // 3, 3))


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP of an RGB array."""
    height, width, _ = image.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    header = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return header + rows.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    """An array of [height, width, channels], 8 bits each. Raises ValueError for anything else."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if not (m := _HEADER.match(data)) or int(m[4]) != 255:
        raise ValueError("not a binary 8-bit Netpbm or BMP image")
    width, height, channels = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
    if len(data) - m.end() < width * height * channels:
        raise ValueError("the image ends early")
    return np.frombuffer(data, np.uint8, width * height * channels, m.end()).reshape(height, width, channels)


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, size, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if size < 40 or packing or bits not in (8, 24):
        raise ValueError("only uncompressed BMP images of 8 or 24 bits are read")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if height > 0:
        rows = rows[::-1]
    if bits == 24:
        return rows[:, :, ::-1]
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.zeros((256, 3), np.uint8)
    palette[:colours] = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    return palette[rows[:, :, 0]]


def grey_of(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0] if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def _sums(integral: np.ndarray, n: int) -> np.ndarray:
    """Sums over n equal, fractional stretches of the first axis, from running sums that begin with 0."""
    size = len(integral) - 1
    edges = np.arange(n + 1) * (size / n)
    low = np.minimum(edges.astype(np.int64), size - 1)
    part = (edges - low)[:, None]
    return np.diff(integral[low] * (1 - part) + integral[low + 1] * part, axis=0)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Grey means over equal boxes, with fractional edges, from integral images: of each stripe of rows along its rows, then of what is left down the columns. So a tall image takes a stripe's memory and `width` numbers for each row."""
    rows = np.zeros((len(image) + 1, width))
    for k in range(0, len(image), STRIPE):
        stripe = image[k : k + STRIPE]
        across = np.cumsum(grey_of(stripe) if stripe.ndim == 3 else stripe, axis=1, dtype=np.float64)
        rows[k + 1 : k + 1 + len(stripe)] = _sums(np.concatenate([np.zeros((1, len(stripe))), across.T]), width).T
    np.cumsum(rows, axis=0, out=rows)
    return _sums(rows, height) / (image.shape[0] * image.shape[1] / (height * width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 areas is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile_of(image: np.ndarray) -> bytes:
    """The area-resized image as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(image, TILE, TILE)).astype(np.uint8))
    return out.getvalue()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: each text's payload as an image."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        media = [encode_image(payload_of(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes stored images: id_col, n_bytes, digests of payload and media, the difference hash (dhash) and the tile as an NPY file."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(2).to_pylist():
            image = decode_image(data)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), tile_of(image)))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [id_col, "n_bytes", *names])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary"
    return map_arrow(media.select(F.col(id_col), "n_bytes", "media"), run, schema)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image in the shared folder, reads the images back, writes their tiles with difference hashes, and reads those back: features(), and `feature` of hash and tile."""
    tiles = materialise(features(materialise(store(docs, id_col, text_col), "media", "zstd"), id_col), "tiles", "zstd")
    return tiles.withColumn("feature", F.concat_ws(":", "dhash", F.left(F.sha2("tile", 256), F.lit(16))))
