"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, difference hashes.

Decoders take the plain and raw forms of PBM, PGM and PPM (P1 to P6, up to 16 bits a
sample) and uncompressed BMP with 8, 24 or 32 bits a pixel.  Bytes that are no such image
decode to ``None`` and give null results.  Resizing takes the mean over each target cell,
read from an integral image in whole numbers, so equal images give equal tiles everywhere.

``stored_media`` writes the images of texts as a table and reads it back; ``stored_features`` decodes what was read and writes
NPY tiles and digests as another table.  A null text is an empty text; texts of any length become one image
of 64 RGB pixels a row; equal texts give equal rows.  Rows without an id and repeated rows are kept as they are; an empty table gives empty
tables.  Other columns are ignored.  ``tiles`` replaces columns named like those it adds.
"""

from __future__ import annotations

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

from chartloom.llm.common import text_groups, whole_text, work_path

#: A payload row: 64 pixels of 3 samples.
ROW_BYTES = 192
TILE = (8, 9)

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_netpbm(samples: np.ndarray) -> bytes:
    """Raw PGM of a (height, width) array or raw PPM of a (height, width, 3) array of 8-bit samples."""
    height, width = samples.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if samples.ndim == 2 else 6, width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit BMP of a (height, width, 3) array of 8-bit RGB samples."""
    height, width = samples.shape[:2]
    stride = -(-3 * width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = samples[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray | None:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return None
    fields, at = [], 2
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found or not found[1].isdigit():
            return None
        fields.append(int(found[1]))
        at = found.end()
    width, height, most = (*fields, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not (width and height and 0 < most < 65536):
        return None
    if kind == b"P4":
        stride = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, offset=at + 1)
        if len(raw) < stride * height:
            return None
        return 1 - np.unpackbits(raw[: stride * height].reshape(height, stride), axis=1)[:, :width]
    count = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b" ", data[at:])
        words = [bytes([c]) for c in body if c in b"01"] if kind == b"P1" else body.split()
        if len(words) < count:
            return None
        out = np.array([int(w) for w in words[:count]])
        out = 1 - out if kind == b"P1" else out
    else:
        wide = most > 255
        raw = np.frombuffer(data, np.uint8, offset=at + 1)
        if len(raw) < count * (1 + wide):
            return None
        out = raw[: 2 * count].view(">u2") if wide else raw[:count]
    out = out.astype(np.uint16 if most > 255 else np.uint8)
    return out.reshape(height, width, 3) if channels == 3 else out.reshape(height, width)


def decode_bmp(data: bytes) -> np.ndarray | None:
    if data[:2] != b"BM" or len(data) < 54:
        return None
    offset, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        return None
    stride, rows = -(-width * bits // 32) * 4, abs(height)
    if len(data) < offset + stride * rows:
        return None
    pixels = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)[:: -1 if height > 0 else 1]
    if bits == 8:
        colors = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * colors, 14 + head).reshape(colors, 4)[:, 2::-1]
        index = pixels[:, :width]
        return palette[index] if index.max(initial=0) < colors else None
    return pixels[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    if not data:
        return None
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def luma(image: np.ndarray) -> np.ndarray:
    """Brightness as whole numbers (a hundredth of a sample step)."""
    wide = image.astype(np.int64)
    return wide * 100 if wide.ndim == 2 else wide @ np.array([30, 59, 11])


def _along(integral: np.ndarray, size: int) -> np.ndarray:
    """Differences of an integral image at ``size`` equal cells of its first axis, times ``size``."""
    n = len(integral) - 1
    whole, part = np.divmod(np.arange(size + 1) * n, size)
    part = part.reshape(-1, *[1] * (integral.ndim - 1))
    at = integral[whole] * (size - part) + integral[np.minimum(whole + 1, n)] * part
    return np.diff(at, axis=0)


def area_resize(gray: np.ndarray, shape: tuple[int, int] = TILE) -> np.ndarray:
    """Mean of each cell of a ``shape`` grid laid over the image, cut pixels by their share."""
    integral = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.int64), axis=1, out=integral[1:, 1:])
    cells = _along(_along(integral, shape[0]).T, shape[1]).T
    return cells // (gray.shape[0] * gray.shape[1])


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(cells: np.ndarray) -> str:
    """One bit per horizontal neighbours: is the right one brighter?"""
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def tile_of(image: np.ndarray | None) -> tuple[bytes | None, str | None]:
    """NPY bytes of the resized tile (8-bit for 8-bit images) and its difference hash."""
    if image is None:
        return None, None
    cells = area_resize(luma(image))
    return npy_bytes((cells // 100).astype(image.dtype)), difference_hash(cells)


def payload_image(text: bytes) -> np.ndarray:
    """The bytes, filled up with spaces to whole rows, as an RGB image."""
    rows = max(1, -(-len(text) // ROW_BYTES))
    return np.frombuffer(text.ljust(rows * ROW_BYTES), np.uint8).reshape(rows, ROW_BYTES // 3, 3)


def tiles(media: DataFrame, column: str = "media") -> DataFrame:
    """Add ``height``, ``width``, ``tile`` (NPY bytes) and ``dhash`` to rows with stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [decode(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            done = [tile_of(image) for image in images]
            yield pa.RecordBatch.from_arrays([
                *batch.columns,
                pa.array([None if x is None else x.shape[0] for x in images], pa.int32()),
                pa.array([None if x is None else x.shape[1] for x in images], pa.int32()),
                pa.array([t for t, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string()),
            ], names=[*batch.schema.names, "height", "width", "tile", "dhash"])

    media = media.drop("height", "width", "tile", "dhash")
    fields = ", ".join(f"`{name}` {kind}" for name, kind in media.dtypes)
    return media.mapInArrow(run, fields + ", height int, width int, tile binary, dhash string")


def text_media(docs: DataFrame, form: str = "ppm") -> DataFrame:
    """doc_id, n_bytes and the stored image (``ppm`` or ``bmp``) of each whole text."""
    write = encode_bmp if form == "bmp" else encode_netpbm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch):
                media = [write(payload_image(text)) for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored images, all taken from the decoded bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile binary"
    )

    def features(data: bytes) -> tuple:
        image = decode(data)
        payload = np.ascontiguousarray(image).tobytes()
        tile, dhash = tile_of(image)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
            len(data), hashlib.sha256(data).hexdigest(), dhash, tile,
        )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stored in text_groups(batch, "media"):
                found = [features(x) for x in stored]
                made = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(found)) for c in batch.columns[:2]), *made], names=names)

    return media.mapInArrow(run, schema)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_media(docs: DataFrame, form: str = "ppm", path: str | None = None) -> DataFrame:
    """The image table of all texts, written (below the shared folder if no path is given) and read back."""
    return _stored(text_media(docs, form), path or work_path(docs.sparkSession, "media"))


def stored_features(media: DataFrame, path: str | None = None) -> DataFrame:
    """The table of NPY tiles and digests of stored images, written and read back."""
    return _stored(media_features(media), path or work_path(media.sparkSession, "tiles"))
