import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rollcheck.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([97, 98, 99, 255, 0]), min_size=1, max_size=120))
def test_suffix_array_and_prefixes(symbols):
    t = np.array(symbols, np.uint8)
    sa = suffix.suffix_array(t)
    pad = bytes(t) + b"\xff" * 200
    assert sorted(sa) == list(range(len(t)))
    keys = [pad[i : i + 200] for i in sa]
    assert keys == sorted(keys)
    for k, got in enumerate(suffix.common_prefixes(sa, suffix.words_at(t), 50)):
        want = 0
        while k and want < 50 and keys[k][want] == keys[k - 1][want]:
            want += 1
        assert got == want


def brute(rows, length=50):
    raw = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, r in raw:
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for (d, r), (orig, _) in zip(raw, rows):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if least[r[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if len(r) else b""
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(orig), len(r), int(gone.sum()), runs, kept))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        body = [" ".join(word() for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            body += [p[a : a + rng.randint(20, len(p))], word()]
        rows.append((i * 3 % 61, " ".join(body)))
    rows += [(7, rows[0][1]), (200, rows[0][1]), (201, rows[1][1]), (201, rows[1][1]), (202, None), (203, ""), (204, "z" * 3000), (205, "z" * 400), (None, rows[2][1]), (None, "z" * 60), (206, "ab" * 2000)]
    return rows


def test_rows_equal_brute_force(spark):
    rows = made(1)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    for options in ({}, {"most_places": 1}, {"most_bodies": 2}, {"copies_limit": -1, "most_bodies": 6}, {"copies_limit": -1, "table_bits": 12}):
        got = suffix.remove_repeats(df, **options).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute(rows)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_texts_of_one_id_with_one_key(spark, monkeypatch):
    """Different texts without an id, or with one id, whose first keys are equal: the marks of one are not the other's."""
    shared = "a passage that stands in the first document and in one of the others, too, word for word"
    rows = [(1, shared + " one"), (None, "x " + shared), (None, "nothing of it here " * 8), (7, shared), (7, "another text of that id " * 5), (None, None)]
    keys = suffix._text_key
    monkeypatch.setattr(suffix, "_text_key", lambda salt: F.lit(5).cast("long") if salt < 2 else keys(salt))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"copies_limit": -1}):
        got = sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(df, **options).collect())
        assert got == sorted((str(d), n, k) for d, n, k in brute_rows(rows))
    assert any(n for _, n, _ in got)


def brute_rows(rows, length=50):
    raw = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    out = []
    for d, r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if any(e < d and r[i : i + length] in q for e, q in raw):
                gone[i : i + length] = [True] * length
        out.append((None if d == 2**63 - 1 else d, sum(gone), bytes(c for c, g in zip(r, gone) if not g)))
    return out


def test_lists_of_bodies_lose_no_pair():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(30)) for _ in range(6)]
    raw = [" ".join(rng.choice(words) for _ in range(20)).encode() for _ in range(40)]
    s = suffix.Segments(raw, 50)
    at = np.flatnonzero(s.anchor == np.unique(s.anchor, return_counts=True)[0][np.argmax(np.unique(s.anchor, return_counts=True)[1])])
    body = list(dict.fromkeys(s.bodies(s.doc[at], s.first[at], s.n[at])))
    lo = np.array([rng.randrange(50) for _ in body])
    whole = set(zip(*(x.tolist() for x in suffix._repeats(body, lo, 50))))
    assert len(body) > 8 and whole
    for most in (1, 3, 7):
        found = set()
        for part in suffix._together(body, 50, most):
            which, window = suffix._repeats([body[i] for i in part.tolist()], lo[part], 50)
            found |= set(zip(part[which].tolist(), window.tolist()))
        assert found == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([97, 98, 255, 0]), st.booleans()), min_size=1, max_size=120))
def test_wanted_suffixes_keep_their_order(symbols):
    t, wanted = np.array([c for c, _ in symbols], np.uint8), np.array([w for _, w in symbols])
    whole = suffix.suffix_array(t)
    assert suffix.suffix_array(t, wanted=wanted).tolist() == whole[wanted[whole]].tolist()
