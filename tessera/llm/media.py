"""Media columns: Netpbm and BMP images to arrays, thumbnails, NPY tiles and difference hashes."""

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

TILE = 16
WIDTH = 64
#: Samples of an image in one strip of the integral image.
STRIP = 1 << 20


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """Bytes as a binary 8-bit grey map of the given width; the length must be a multiple of it."""
    height, rest = divmod(len(samples), width)
    if rest or not height:
        raise ValueError("the samples don't fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, height) + samples


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The next ``count`` numbers of a Netpbm header after its magic, and where the last ends."""
    numbers, at = [], 2
    field = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([0-9]+)")
    for _ in range(count):
        m = field.match(data, at)
        if not m:
            raise ValueError("a Netpbm header breaks off")
        numbers.append(int(m[1]))
        at = m.end()
    return numbers, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3) samples; bitmaps have 0 for black and 255 for white.

    Samples of up to 8 bits are uint8, of up to 16 bits uint16; they are kept as stored.
    """
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not a Netpbm image")
    bitmap, plain, channels = kind in b"14", kind in b"123", 3 if kind in b"36" else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    most = 1 if bitmap else numbers[2]
    count = width * height * channels
    kept = np.uint8 if most < 256 else np.uint16
    if plain:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        digits = re.findall(rb"[01]" if bitmap else rb"[0-9]+", body)[:count]
        samples = np.array([int(x) for x in digits], dtype=kept)
    elif bitmap:
        line = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line), axis=1)
        samples = bits[:, :width].reshape(-1)
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), count, at + 1).astype(kept)
    if len(samples) != count:
        raise ValueError("a Netpbm image breaks off")
    if bitmap:
        samples = ((1 - samples) * 255).astype(np.uint8)
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3) uint8 in the order red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    begin, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or head < 40:
        raise ValueError("this kind of BMP is not read")
    rows, line = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, line * rows, begin).reshape(rows, line)
    if depth >= 24:
        pixels = raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    else:
        (used,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << depth), 14 + head).reshape(-1, 4)[:, 2::-1]
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
        index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :width]
        pixels = palette[index]
    return np.ascontiguousarray(pixels if height < 0 else pixels[::-1])


def decode(data: bytes) -> np.ndarray:
    image = decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    if not image.size:
        raise ValueError("an image without pixels")
    return image


def white(data: bytes) -> int:
    """The sample that stands for white: the greatest one that a Netpbm header allows, 255 elsewhere."""
    return max(1, _header(data, 3)[0][2]) if data[:1] == b"P" and data[1:2] in b"2356" else 255


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resizes(image: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (height, width) the mean of the source area under each target pixel.

    One integral image, read at fractional edges, gives all sizes. It is made in strips of rows: of each,
    the sums over columns are kept at the edges alone, and only the last row goes on to the next
    strip, so memory is bounded by a strip (or a row), not the image.
    """
    h, w = image.shape[:2]

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n + 1) * (size / n)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    places = [(edges(height, h), edges(width, w)) for height, width in sizes]
    grids = [np.zeros((height + 1, width + 1)) for height, width in sizes]
    above = [np.zeros(width + 1) for _, width in sizes]
    step = max(1, STRIP // w)
    for top in range(0, h, step):
        strip = grey(image[top : top + step])
        across = np.zeros((len(strip), w + 1), dtype=np.float64)
        np.cumsum(strip, axis=1, dtype=np.float64, out=across[:, 1:])
        for k, ((y, fy), (x, fx)) in enumerate(places):
            total = np.empty((len(strip) + 1, len(x)))
            total[0] = above[k]
            np.cumsum(across[:, x] * (1 - fx) + across[:, x + 1] * fx, axis=0, out=total[1:])
            total[1:] += above[k]
            here = np.flatnonzero((y >= top) & (y < top + len(strip)))
            at = y[here] - top
            grids[k][here] = total[at] * (1 - fy[here])[:, None] + total[at + 1] * fy[here][:, None]
            above[k] = total[-1]
    return [np.diff(np.diff(g, axis=0), axis=1) / ((h / g_h) * (w / g_w)) for g, (g_h, g_w) in zip(grids, sizes)]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_resizes(image, [(height, width)])[0]


def npy(thumbnail: np.ndarray, most: int = 255) -> bytes:
    """A thumbnail as uint8 in NPY format, ``most`` being white."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(thumbnail * (255 / most)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def features(image: np.ndarray, most: int = 255, size: int = TILE) -> tuple[bytes, str]:
    """A size x size thumbnail in NPY format, and the difference hash.

    The hash has 64 bits as 16 hex digits: of an 8 x 9 thumbnail, whether each pixel is darker than its right neighbour.
    """
    tile, small = area_resizes(image, [(size, size), (8, 9)])
    small = np.rint(small * 256)
    return npy(tile, most), np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    return features(image, size=size)[0]


def difference_hash(image: np.ndarray) -> str:
    return features(image)[1]


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """Add height, width, tile (NPY bytes) and dhash for a binary column of Netpbm and BMP images.

    Tiles have 255 for the greatest value that the image's header allows. An image that is null, empty, without pixels or not readable gives nulls in
    all four; columns of these names are replaced, others stay as they are.
    """
    added = "height int, width int, tile binary, dhash string"
    kept = df.drop("height", "width", "tile", "dhash")
    schema = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(batch.schema.get_field_index(content)):
                try:
                    data = data.as_py() or b""
                    image = decode(data)
                    rows.append((*image.shape[:2], *features(image, white(data))))
                except (ValueError, struct.error, IndexError, ZeroDivisionError):
                    rows.append((None,) * 4)
            columns = [pa.array(list(x), type=f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *schema.names])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{names}, {added}")


def payload(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and its bytes followed by zeros up to a positive multiple of ``unit``."""
    data = (text or "").encode("utf-8")
    return len(data), data + bytes(-len(data) % unit or (0 if data else unit))


def media_documents(docs: DataFrame) -> DataFrame:
    """Each text stored as a grey map, decoded again, and described from the decoded samples.

    A null text is empty (one row of zeros). Equal texts give equal values, repeated rows a row each. A very long text is one image, described
    by strips of rows. Further columns of docs are left out, so none can clash; an empty table gives an empty one.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def one(text: str | None) -> tuple:
        n, data = payload(text)
        stored = encode_pgm(data)
        image = decode_netpbm(stored)
        read = np.ascontiguousarray(image).reshape(-1)
        tile, code = features(image)
        return (n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), code, tile)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [one(x.as_py()) for x in part.column(1)]
                columns = [pa.array(list(x), type=t) for x, t in zip(zip(*rows), types[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
