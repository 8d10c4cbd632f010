import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from rollcheck.llm import tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_codes_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = tokens.encode_values(v)
    assert len(control) == -(-len(v) // 4)
    assert (tokens.decode_values(control, data, len(v)) == v).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBé 'srtm9_&²½İΣς́\x1c\x85\n　|<>"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_equals_library(text):
    enc = tokens.encoder(PATH)
    want = enc.library.encode(text, add_special_tokens=False).ids + [2]
    n, ids = enc.encode(pa.array(["x y", text, None, text], pa.string()), 2)
    got = [np.frombuffer(i, enc.kind).tolist() for i in ids.to_pylist()]
    assert got[1] == want == got[3] and got[2] == [2] and n.tolist() == [len(g) for g in got]


def brute(rows):
    lib = Tokenizer.from_file(PATH)
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_match_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "<|endoftext|> It's 3 o'clock"), (10**9 + 3, "longword" * 30000), (None, "last")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = tokens.token_files(df.repartition(7), PATH).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == [(b[1], b[0], b[2], b[3]) for b in brute(rows)]


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (1, "a b"), (2, "d")], "doc_id long, text string")
    got = tokens.token_files(df, PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 1, 1, 2] and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert tokens.token_files(df.limit(0), PATH).count() == 0
