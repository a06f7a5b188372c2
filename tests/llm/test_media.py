import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import media
from corpusloom.llm.queries import op9_media_columns


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.booleans())
def test_round_trip(payload, adaptive):
    stored = media.encode(payload, adaptive=adaptive)
    image, n = media.decode(stored)
    assert image.tobytes() == media.pad(payload) and n == len(payload) and len(image.tobytes()) % 64 == 0 and image.size


def test_all_filters():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (10, 7)).astype(np.uint8)
    kinds = np.array([4, 3, 2, 1, 0, 4, 3, 4, 2, 1])
    rows = np.zeros_like(image)
    for r in range(10):
        for c in range(7):
            a = int(image[r, c - 1]) if c else 0
            b = int(image[r - 1, c]) if r else 0
            d = int(image[r - 1, c - 1]) if r and c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            rows[r, c] = (int(image[r, c]) - [0, a, b, (a + b) // 2, paeth][kinds[r]]) % 256
    assert np.array_equal(media.unfilter(kinds, rows), image)


def test_damage_is_found():
    stored = bytearray(media.encode(b"some text " * 40))
    for at in (3, 20, 60, len(stored) - 6):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(broken))
    with pytest.raises(ValueError):
        media.decode(bytes(stored[:-5]))


def test_hash_is_of_low_frequencies():
    y, x = np.mgrid[0:64, 0:64]
    smooth = (127 + 60 * np.cos(x / 20) + 40 * np.sin(y / 15)).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + np.random.default_rng(0).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    other = (127 + 60 * np.cos(x / 7) * np.sin(y / 5)).astype(np.uint8)
    bits = lambda a, b: (int(media.low_frequency_hash(a), 16) ^ int(media.low_frequency_hash(b), 16)).bit_count()
    assert bits(smooth, smooth) == 0 and bits(smooth, noisy) < bits(smooth, other)


def test_rows(spark):
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (None, "é" * 100), (5, "x" * 200_000), (5, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, 1, "m") for d, t in rows], "doc_id long, text string, n_bytes int, media string")
    back = media.read_media(media.to_media(docs).withColumn("keep", F.col("doc_id"))).collect()
    for r in back:
        t = next((t or "") for d, t in rows if d == r.doc_id).encode()
        assert bytes(r.payload) == media.pad(t) and r.n_bytes == len(t) and r.keep == r.doc_id and len(r.feature) == 16
    assert len(back) == len(rows)
    assert media.read_media(media.to_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "k int, media binary")
    assert media.read_media(nothing).collect()[0].payload is None


def plain_decode(png):
    """Samples of an 8-bit grey PNG by the specification, byte by byte; shares no code with the operator."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, kinds, stream = 8, [], b""
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, rest) == (8, 0, [0, 0, 0])
        stream += body if kind == b"IDAT" else b""
        kinds.append(kind)
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and at == len(png)
    raw, out, used = zlib.decompress(stream), [], set()
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        used.add(line[0])
        row = []
        for x, value in enumerate(line[1:]):
            a = row[x - 1] if x else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - 1] if x and y else 0
            if line[0] == 4:
                p = a + b - c
                distance = [abs(p - a), abs(p - b), abs(p - c)]
                guess = (a, b, c)[distance.index(min(distance))]
            else:
                guess = (0, a, b, (a + b) // 2)[line[0]]
            row.append((value + guess) % 256)
        out.append(row)
    return out, used


def plain_feature(rows):
    """The 64 lowest cosine frequencies of a 32 x 32 reduction, by sums."""

    def reduce(values):
        n = len(values)
        if n < 32:
            return [values[i * n // 32] for i in range(32)]
        edges = [i * n // 32 for i in range(33)]
        return [sum(values[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]

    columns = [reduce([float(r[x]) for r in rows]) for x in range(len(rows[0]))]
    grid = [reduce([c[y] for c in columns]) for y in range(32)]
    wave = [[math.cos(math.pi / 32 * (i + 0.5) * k) for i in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * grid[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return low, middle


def test_query_against_an_independent_decoder(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 3000 OR text IS NULL")
    stored = {r.doc_id: bytes(r.media) for r in media.to_media(docs).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen, filters = {}, set()
    for r in op9_media_columns(spark, folder).collect():
        if r.doc_id not in texts:
            continue
        rows, used = plain_decode(stored[r.doc_id])
        filters |= used
        payload = bytes(x for row in rows for x in row)
        padded = texts[r.doc_id] + bytes((-len(texts[r.doc_id]) % 64) or (0 if texts[r.doc_id] else 64))
        assert payload == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert seen.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        low, middle = plain_feature(rows)
        for i, bit in enumerate(f"{int(r.feature, 16):064b}"[1:], 1):
            assert abs(low[i] - middle) < 1e-6 or (low[i] > middle) == (bit == "1")
    assert len(filters) > 2


def test_many_images_at_once_and_sizes():
    rng = np.random.default_rng(3)
    payloads = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 700, 9000, 64 * 80)]
    offsets = np.cumsum([0, *map(len, payloads)])
    stored = media.encode_all(np.frombuffer(b"".join(payloads), np.uint8), offsets)
    assert stored == [media.encode(p) for p in payloads]
    assert [media.size_of(m) for m in stored] == [len(media.pad(p)) for p in payloads]
    other = media.encode(payloads[5], width=7)
    for (image, n), p in zip(media.decode_all([*stored, other]), [*payloads, payloads[5]]):
        assert image.tobytes()[:n] == p


def test_blocks_are_cut_by_samples():
    stored = media.encode(b"a" * (3 << 20))  # a small stream of many samples
    assert len(stored) < media.BLOCK_BYTES // 8
    small = media.encode(b"a" * (300 << 10))
    batch = pa.RecordBatch.from_arrays([pa.array([stored, stored, small, small, small, small, None, stored], pa.binary())], ["m"])
    assert [len(m) for _, m in media._by_samples([batch], 0)] == [1, 1, 3, 2, 1]
