"""Media columns: byte payloads as PNG in binary columns, and hashes of their low frequencies.

A payload becomes an 8-bit grey image 64 samples wide. The container is
written and read here, from its published specification, over zlib streams:
every chunk's checksum is tested on reading and rows are unfiltered in numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from corpusloom.llm._text import BLOCK_BYTES, blocks, buffers

# Fixed values of the container's specification.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
#: Bytes of a compressed stream in one chunk at most.
CHUNK = 1 << 20
#: Private ancillary chunk with the payload's unpadded length.
LENGTH_CHUNK = b"byLn"
_GRID = 32
_LOW = 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """Zeros up to a positive multiple of ``width``."""
    return payload + bytes(-len(payload) % width or (0 if payload else width))


def paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + above - corner, ties in this order."""
    far_left, far_above = np.abs(above - corner), np.abs(left - corner)
    far_corner = np.abs(left + above - 2 * corner)
    return np.where((far_left <= far_above) & (far_left <= far_corner), left, np.where(far_above <= far_corner, above, corner))


def filter_rows(image: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filter of each row, filtered rows) of images on top of each other: of the five filters the one with the smallest absolute sum."""
    left, above, corner = (np.zeros(image.shape, np.int16) for _ in range(3))
    left[:, 1:] = image[:, :-1]
    above[1:] = image[:-1]
    above[top] = 0
    corner[:, 1:] = above[:, :-1]
    tries = [image - guess.astype(np.uint8) for guess in (np.zeros(1), left, above, (left + above) >> 1, paeth(left, above, corner))]
    best = np.stack([np.minimum(t, 0 - t).sum(axis=1, dtype=np.int64) for t in tries]).argmin(axis=0)
    return best, np.choose(best[:, None], tries)


def encode_all(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, level: int = 1, adaptive: bool = True) -> list[bytes]:
    """A PNG for each payload of a block; its samples are the payload, padded. ``adaptive`` chooses a filter for each row, else there is none."""
    size = np.diff(offsets)
    rows = np.maximum(-(-size // width), 1)
    first = np.concatenate([[0], np.cumsum(rows)])
    image = np.zeros(first[-1] * width, np.uint8)
    image[np.arange(size.sum()) + np.repeat(first[:-1] * width - offsets[:-1] + offsets[0], size)] = data[offsets[0] : offsets[-1]]
    image = image.reshape(-1, width)
    table = np.zeros((len(image), width + 1), np.uint8)
    table[:, 0], table[:, 1:] = filter_rows(image, first[:-1]) if adaptive else (NONE, image)
    out = []
    for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), size.tolist()):
        stream = zlib.compress(table[a:b].tobytes(), level)
        parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, b - a, 8, 0, 0, 0, 0)), _chunk(LENGTH_CHUNK, struct.pack(">Q", n))]
        parts += [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
        out.append(b"".join([*parts, _chunk(b"IEND", b"")]))
    return out


def encode(payload: bytes, width: int = WIDTH, level: int = 1, adaptive: bool = True) -> bytes:
    """A PNG whose samples are the padded payload."""
    return encode_all(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]), width, level, adaptive)[0]


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; ValueError where the container is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + n
    if kind != b"IEND" or at != len(media):
        raise ValueError("truncated PNG")


def unfilter(kinds: np.ndarray, rows: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Undo the five row filters, one byte per sample, for images on top of each other; ``first`` are their first rows."""
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError(f"filter {kinds.max()}")
    first = np.zeros(min(len(rows), 1), np.int64) if first is None else first
    height = np.diff(np.append(first, len(rows)))
    out = rows.copy()
    sub = kinds == SUB
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    chained = np.add.reduceat(kinds >= UP, first) > 0 if len(first) else np.zeros(0, bool)
    if chained.any():
        _unfilter_diagonals(kinds, rows, out, first[chained], height[chained])
    return out


def _unfilter_diagonals(kinds: np.ndarray, rows: np.ndarray, out: np.ndarray, first: np.ndarray, height: np.ndarray) -> None:
    """All images at once, one diagonal a step: a sample needs those to its left, above it and between, all on earlier diagonals.

    Lane j of an image has the rows j, j + width, ... in turn, so it is busy at every step and its
    neighbour lane has just left the row above.
    """
    width = rows.shape[1]
    order = np.argsort(-height, kind="stable")
    first, height = first[order], height[order]
    lane = np.arange(width)
    last = np.zeros((len(first), width), np.int16)
    before = last.copy()
    ends = height + width - 1
    for d in range(int(ends[0])):
        live = int(np.searchsorted(-ends, -d, side="left"))  # images with steps left; the tallest come first
        x = (d - lane) % width
        y = d - x
        inside = (y >= 0) & (y < height[:live, None])
        at = np.where(inside, first[:live, None] + y, first[:live, None])
        left, above, corner = last[:live].copy(), np.roll(last[:live], 1, axis=1), np.roll(before[:live], 1, axis=1)
        left[:, x == 0] = 0
        corner[:, x == 0] = 0
        above[:, y == 0] = 0
        corner[:, y == 0] = 0
        guess = np.choose(kinds[at], (np.int16(0), left, above, (left + above) >> 1, paeth(left, above, corner)))
        value = (rows[at, x] + guess) & 255
        out[at[inside], np.broadcast_to(x, at.shape)[inside]] = value[inside]
        before[:live] = last[:live]
        last[:live] = value


def size_of(media: bytes) -> int:
    """Samples that a header promises, read without decoding; 0 where there is none."""
    return int(np.prod(struct.unpack_from(">II", media, 16), dtype=object)) if len(media) >= 24 else 0


def _stream(media: bytes) -> tuple[np.ndarray, int]:
    """(rows with their filter in front, payload length) of one image."""
    header, length, stream = None, None, []
    for kind, body in chunks(media):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == LENGTH_CHUNK:
            (length,) = struct.unpack(">Q", body)
        elif kind == b"IDAT":
            stream.append(body)
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace")
    width, height = header[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    except zlib.error as fault:
        raise ValueError(str(fault)) from fault
    if len(raw) != height * (width + 1):
        raise ValueError("size of the samples")
    return raw.reshape(height, width + 1), width * height if length is None else length


def decode_all(media: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(samples, payload length) of each image; the length is that of the samples where it was not stored."""
    found = [_stream(m) for m in media]
    images: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(found)
    for width in {rows.shape[1] for rows, _ in found}:
        own = [i for i, (rows, _) in enumerate(found) if rows.shape[1] == width]
        whole = np.concatenate([found[i][0] for i in own])
        ends = np.cumsum([len(found[i][0]) for i in own])
        filled = [i for i in own if len(found[i][0])]
        first = np.cumsum([0, *(len(found[i][0]) for i in filled)])[:-1]
        samples = unfilter(whole[:, 0], whole[:, 1:], first)
        for i, image in zip(own, np.split(samples, ends[:-1])):
            images[i] = image
    return [(image, n) for image, (_, n) in zip(images, found)]


def decode(media: bytes) -> tuple[np.ndarray, int]:
    return decode_all([media])[0]


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


_BASIS = _cosines(_GRID, _LOW)


def low_frequency_hash(image: np.ndarray) -> str:
    """64 signs of an image's lowest cosine frequencies against their median, as 16 hex digits.

    The image is first averaged (or stretched) to a 32 x 32 grid.
    """
    grid = image.astype(np.float64)
    for axis in (0, 1):
        n = grid.shape[axis]
        if n >= _GRID:
            edges = np.arange(_GRID) * n // _GRID
            shape = [1, 1]
            shape[axis] = _GRID
            grid = np.add.reduceat(grid, edges, axis=axis) / np.diff(np.append(edges, n)).reshape(shape)
        else:
            grid = grid.take(np.arange(_GRID) * n // _GRID, axis=axis)
    low = (_BASIS @ grid @ _BASIS.T).ravel()
    bits = low > np.partition(low[1:], 31)[31]
    bits[0] = low[0] > 127.5 * _GRID * _GRID
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, level: int = 1, adaptive: bool = True) -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's UTF-8 bytes as PNG.

    Null text is empty, and an empty payload is one row of zeros. A text of any length is one
    image. Equal texts give equal media; repeated rows and null ids stay as they are. Extra
    columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = buffers(batch.column(1))
            media = encode_all(data, offsets, level=level, adaptive=adaptive)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _by_samples(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Row ranges whose images have about ``BLOCK_BYTES`` samples together, however small they are compressed."""
    for batch in batches:
        media = [m.as_py() if m.is_valid else None for m in batch.column(column)]
        size = np.cumsum([0, *(0 if m is None else size_of(m) for m in media)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + BLOCK_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at), media[at:to]
            at = to


def read_media(frame: DataFrame, column: str = "media") -> DataFrame:
    """Decode a media column: all other columns plus payload (padded samples), n_bytes and feature.

    Null media gives nulls; damaged media stops the job with its fault. Repeated rows stay
    repeated, an empty table gives an empty result. Columns of those names in ``frame`` are replaced.
    """
    kept = [f for f in frame.schema.fields if f.name not in (column, "payload", "n_bytes", "feature")]
    names = [f.name for f in kept]
    schema = StructType([*kept, StructField("payload", BinaryType()), StructField("n_bytes", LongType()), StructField("feature", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in _by_samples(batches, len(names)):
            found = iter(decode_all([m for m in media if m is not None]))
            rows = [(None, None, None) if m is None else (lambda image, n: (image.tobytes(), n, low_frequency_hash(image)))(*next(found)) for m in media]
            payload, length, feature = zip(*rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(payload, pa.binary()), pa.array(length, pa.int64()), pa.array(feature, pa.string())], [*names, "payload", "n_bytes", "feature"])

    return frame.select(*names, F.col(column).alias("__media")).mapInArrow(run, schema)
