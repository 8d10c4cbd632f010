"""Bytes as PNG images in a binary column, and low-frequency cosine-transform hashes of them.

A payload becomes a grey 8-bit image. The writer chooses for each row the filter with the smallest
sum of residues among none, sub and up; the reader takes any non-interlaced grey 8-bit PNG, tests
every chunk's checksum and undoes all five filters.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, small_batches, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT = 576
PAD = 255


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A PNG of a (height, width) array of 8-bit grey samples."""
    height, width = samples.shape
    up = samples - np.concatenate((np.zeros((1, width), np.uint8), samples[:-1]))
    sub = samples - np.concatenate((np.zeros((height, 1), np.uint8), samples[:, :-1]), axis=1)
    choices = np.stack((samples, sub, up))
    size = np.abs(choices.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = size.argmin(0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = choices[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (first byte of each row: the filter), for one byte a sample."""
    kinds, x = rows[:, 0], rows[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown PNG filter")
    sub = kinds == 1
    x[sub] = np.cumsum(x[sub], axis=1, dtype=np.uint8)
    above = np.zeros(x.shape[1], np.uint8)
    for y in np.flatnonzero(kinds > 1):
        above = x[y - 1] if y else np.zeros(x.shape[1], np.uint8)
        if kinds[y] == 2:
            x[y] += above
            continue
        left = corner = 0
        for k in range(x.shape[1]):
            b = int(above[k])
            if kinds[y] == 3:
                guess = (left + b) // 2
            else:
                p = left + b - corner
                guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
            left = (int(x[y, k]) + guess) & 0xFF
            x[y, k] = left
            corner = b
    return x


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG; ValueError if a checksum, the order of chunks or the size is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit PNG without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(rows) != head[1] * (head[0] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(rows.reshape(head[1], head[0] + 1))


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal stretches of the first axis, with shares of the samples at their edges."""
    total = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))
    edge = np.linspace(0, len(x), n + 1)
    low = np.minimum(edge.astype(int), len(x) - 1)
    at = total[low] + (edge - low).reshape(-1, *[1] * (x.ndim - 1)) * x[low]
    return np.diff(at, axis=0) * n / len(x)


def _cosines(n: int, kept: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(kept)[:, None] / (2 * n))


COSINES = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: whether each of the 8 x 8 lowest frequencies of the 32 x 32 image exceeds their median (the mean left out)."""
    small = _shrink(_shrink(samples, 32).T, 32).T
    low = np.round(COSINES @ small @ COSINES.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a PNG, padded with 255 to a positive multiple of 576, 576 samples a row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = texts(b)
            media = [write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, UNIT)) for t in whole]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in whole], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """The media table with payload (the samples read back) and hash (64 bits); a damaged image fails its task."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back, hashes = [], []
            for data in b.column(2).to_pylist():
                samples = read_png(data)
                back.append(samples.tobytes())
                hashes.append(cosine_hash(samples))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "n_bytes", "media", "payload", "hash"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, hash binary")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, payload, hash of every row; a null or empty text is one row of padding.

    Equal texts give equal images and hashes; repeated rows and null ids stay; other columns are not read.
    """
    return features(store(docs, id_col, text_col))


def restore(media: DataFrame) -> DataFrame:
    """(doc_id, text): the texts that the payloads hold."""
    return media.select("doc_id", F.decode(F.substring("payload", F.lit(1), F.col("n_bytes").cast("int")), "UTF-8").alias("text"))
