import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rollcheck.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most, share, top):
    """Every n-gram of every piece counted by definition."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    held = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i : i + k]] = max(held[lang, w[i : i + k]], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * held[lang, w] >= share * a:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def made_rows():
    rng = np.random.default_rng(5)
    common = ["New York City", "in the", "as well as", "of", "É a", "a", "b", "x\x0by", "tab\tbed", "stop. Go", "Ünder", "ſ K"]
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(common, rng.integers(0, 30)))
        rows.append((["en", "de", None, "und", "zz"][k % 5], text if k % 50 else None))
    return rows + [("en", ""), ("en", " . ,, "), ("fr", "only once here")]


@pytest.mark.parametrize("shard", [phrases.SHARD, 7])
def test_equals_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)  # 7: several tries of each length
    rows = made_rows()
    df = spark.createDataFrame([(lang, t, 1, "w") for lang, t in rows], "lang string, text string, n int, phrase string").repartition(3)
    for args in [(30, 4, 80, 2000), (5, 4, 95, 3)] if shard > 7 else [(20, 3, 80, 2000)]:
        got = sorted(tuple(r) for r in phrases.collocations(df, *args).collect())
        assert got == brute(rows, *args) and got
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.filter("lang = 'fr'")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 400), st.integers(1, 60), st.integers(0, 99))
def test_trie_counts_occurrences(k, many, symbols, seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(1, 1 << 63, symbols).astype(np.uint64)
    cand = np.unique(words[rng.integers(0, symbols, (many, k))], axis=0)
    trie = phrases.Trie(cand)
    text = np.concatenate([words[rng.integers(0, symbols, 300)], cand.ravel(), rng.integers(1, 1 << 63, 20).astype(np.uint64)])
    codes, places = np.unique(np.r_[np.uint64(0), text], return_inverse=True)
    places = places[1:]
    at, states = trie.accepted(trie.numbers(codes), places)
    want = {tuple(c): 0 for c in cand.tolist()}
    where = []
    for i in range(len(text) - k + 1):
        gram = tuple(text[i : i + k].tolist())
        if gram in want:
            want[gram] += 1
            where.append(i)
    assert at.tolist() == where
    hit, n = np.unique(states, return_counts=True)
    assert {tuple(p): c for p, c in zip(trie.phrases(hit).tolist(), n.tolist())} == {p: c for p, c in want.items() if c}


def test_codes_are_sparks(spark):
    df = spark.createDataFrame([("en", "é"), ("", "a"), ("de", "")], "lang string, word string")
    for r in df.selectExpr("*", "xxhash64(lang, word) as h").collect():
        assert phrases._code(42, r.lang, r.word.encode()) == r.h % (1 << 64)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op13_collocations"])
    want = sorted(rel.select("lang, rank, phrase, a, l, r, n, score").fetchall())
    got = queries.op13_collocations(spark, sf)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_no_trie_goes_through_the_driver(spark, monkeypatch):
    """The driver collects counts and names of files only, and broadcasts nothing, however many tries there are."""
    monkeypatch.setattr(phrases, "SHARD", 40)
    got, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pytest.fail("broadcast"))
    rows = made_rows()
    df = spark.createDataFrame(rows, "lang string, text string")
    found = phrases.collocations(df, 20, 3, 80, 2000)
    held = [v for rows in got for r in rows for v in r if isinstance(v, (bytes, bytearray))]
    assert got and not held
    monkeypatch.undo()
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 20, 3, 80, 2000)
