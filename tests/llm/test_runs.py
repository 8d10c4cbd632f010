import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from rollcheck.llm import queries, runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute(w):
    """All runs by definition: for each period, maximal stretches of words equal to those q later."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q) and smallest_period(w[s : i + q]) == q:
                out.append((s, i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


LETTERS = st.lists(st.sampled_from("abc"), min_size=1, max_size=9)
TEXTS = st.lists(st.tuples(LETTERS, st.integers(1, 6)), max_size=8).map(lambda parts: [c for p, k in parts for c in p * k])


@settings(max_examples=1500, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_runs_equal_definition(docs):
    got = list(runs.runs_of_batch([" ".join(d) for d in docs]))
    assert [r for _, r in got] == [brute(d) for d in docs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_grammar_derives_its_text(seq):
    rules, rest = runs.grammar(seq)

    def expand(s):
        return expand(rules[-1 - s][0]) + expand(rules[-1 - s][1]) if s < 0 else [s]

    assert [x for s, _ in rest for x in expand(s)] == seq
    for k, (_, _, at) in enumerate(rules):
        whole = expand(-1 - k)
        assert seq[at : at + len(whole)] == whole
    pairs = [(a, b) for (a, _), (b, _) in zip(rest, rest[1:])]
    assert len(set(pairs)) >= len(pairs) - sum(a == b for a, b in pairs)


def test_long_texts_stay_cheap():
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 3_000, 9_000)]
    once = list(runs.runs_of_batch([" ".join(base * 2), " ".join(["x"] * 60_000), " ".join(base)]))
    assert once[0][1] == [(0, 18_000, 9_000)]
    assert once[1][1] == [(0, 60_000, 1)]
    assert once[2][1] == []


def test_rows_and_query(spark, tmp_path):
    rows = [(k, " ".join(f"{'ab'[k % 2]}{j % (k % 7 + 2)}" for j in range(5 + 9 * k))) for k in range(40)]
    rows += [(None, "x y " * 9), (3, None), (4, ""), (5, " \t\n"), (3, "é ſ a b " * 6), (3, "é ſ a b " * 6), (6, "one")]
    df = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, runs string, period int")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect())
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        rs = brute(w)
        gone = {i for s, e, q in rs for i in range(s + q, e)}
        want.append((str(d), len(w), [(s, e - s, q) for s, e, q in rs], b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert got == sorted(want)
    assert runs.periodic_runs(df.limit(0)).count() == 0

    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, (tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).collect())))
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(b"" if d is None else str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        rs = brute(w)
        gone = {i for s, e, q in rs for i in range(s + q, e)}
        best = min(rs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
        digest = hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in rs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        want.append((d, len(rs), *four, digest, kept))
    assert got == sorted(map(str, want))
    assert any("None, None" not in r for r in got)
