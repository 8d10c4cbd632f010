import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rollcheck.llm import media


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_png_round_trip(height, width, seed):
    x = np.random.default_rng(seed).integers(0, 256, (height, width)).astype(np.uint8)
    assert (media.read_png(media.write_png(x)) == x).all()


def filtered(x, kinds):
    rows = []
    for y, kind in enumerate(kinds):
        out = [kind]
        for k in range(x.shape[1]):
            a = int(x[y, k - 1]) if k else 0
            b = int(x[y - 1, k]) if y else 0
            c = int(x[y - 1, k - 1]) if k and y else 0
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = [0, a, b, (a + b) // 2, a if pa <= pb and pa <= pc else b if pb <= pc else c][kind]
            out.append((int(x[y, k]) - guess) % 256)
        rows.append(out)
    return np.array(rows, np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.integers(0, 1000))
def test_all_filters(kinds, seed):
    x = np.random.default_rng(seed).integers(0, 256, (len(kinds), 11)).astype(np.uint8)
    assert (media.unfilter(filtered(x, kinds)) == x).all()


def test_damage_is_found():
    good = media.write_png(np.arange(64, dtype=np.uint8).reshape(8, 8))
    bad = bytearray(good)
    bad[45] ^= 1
    for data in (bytes(bad), good[:-3], b"x" + good[1:]):
        with pytest.raises((ValueError, struct.error)):
            media.read_png(data)


def test_hash_is_stable_under_small_changes():
    x = np.random.default_rng(5).integers(0, 256, (64, 576)).astype(np.uint8)
    y = x.copy()
    y[10, 10] ^= 3
    bits = lambda h: int.from_bytes(h, "big")
    assert (bits(media.cosine_hash(x)) ^ bits(media.cosine_hash(y))).bit_count() <= 2
    z = np.random.default_rng(6).integers(0, 256, (64, 576)).astype(np.uint8)
    assert (bits(media.cosine_hash(x)) ^ bits(media.cosine_hash(z))).bit_count() > 8


def test_rows(spark):
    rows = [(1, "é" * 288), (2, None), (3, ""), (None, "a" * 577), (4, "long words " * 20_000), (1, "é" * 288)]
    df = spark.createDataFrame([(d, t, b"") for d, t in rows], "doc_id long, text string, media binary")
    made = media.media_columns(df)
    got = made.collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for d, t in rows:
        raw = (t or "").encode()
        r = by[(d, len(raw))]
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(r.payload) == want and len(r.hash) == 8
        assert hashlib.sha256(r.payload).digest() == hashlib.sha256(want).digest() and zlib.crc32(r.payload[-32:]) == zlib.crc32(want[-32:])
    assert sorted(r.text for r in media.restore(made).collect()) == sorted(t or "" for _, t in rows)
    assert media.media_columns(df.limit(0)).count() == 0
