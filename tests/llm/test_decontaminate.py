import random

import numpy as np
from rollcheck.llm import decontaminate as dc


def edits_in(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs, items, similarity=0.8):
    out = {}
    for d, t in docs:
        for i, s in items:
            w = dc.words(s or "")
            if len(w) >= dc.LEAST_WORDS:
                e = edits_in(w, dc.words(t or ""))
                if e <= dc.allowed_edits(len(w), similarity):
                    out[d, i] = e
    return out


def edited(rng, w, n, vocab):
    w = list(w)
    for _ in range(n):
        k, p = rng.randrange(3), rng.randrange(len(w))
        if k == 0:
            w[p] = rng.choice(vocab)
        elif k == 1:
            del w[p]
        else:
            w.insert(p, rng.choice(vocab))
    return w


def made(seed, n_docs=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(250)] + ["the", "of"] * 20
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 6, 15, 30, 57, 150])))) for i in range(30)]
    docs = []
    for d in range(n_docs):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        w = items[rng.randrange(30)][1].split()
        put = edited(rng, w, rng.choice([0, 0, 1, int(0.1 * len(w)), int(0.2 * len(w)), int(0.3 * len(w))]), vocab)
        docs.append((d, " ".join(body + put + [rng.choice(vocab) for _ in range(rng.randrange(0, 40))])))
    return docs, items


def test_rows_against_brute_force(spark):
    docs, items = made(1)
    docs += [(900, None), (901, ""), (902, items[3][1].upper().replace(" ", "! ")), (903, "x " * 60_000 + items[5][1])]
    want = brute(docs[:-1], items)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, edits int").repartition(3)
    it = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    for block in (20_000, 7):
        got = {(r.doc_id, r.item_id): r.edits for r in dc.find_matches(df, it, block_items=block).collect()}
        assert (903, items[5][0]) in got
        got = {k: v for k, v in got.items() if k[0] != 903}
        assert all(want.get(k) == v for k, v in got.items())
        assert len(got) >= 0.95 * len(want)
        exact = {k for k, v in want.items() if v == 0}
        assert exact <= set(got)
    clean = {r.doc_id for r in dc.drop_contaminated(df, it).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got} - {903}
    assert dc.find_matches(df.limit(0), it).count() == 0 and dc.find_matches(df, it.limit(0)).count() == 0
    assert dc.drop_contaminated(df, it.limit(0)).count() == len(docs)


def test_recall_at_the_limit():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([10, 15, 25, 40, 57])))) for i in range(300)]
    index = dc.Index(items)
    texts, want = [], 0
    for i, s in items:
        w = s.split()
        texts.append(" ".join([rng.choice(vocab) for _ in range(30)] + edited(rng, w, dc.allowed_edits(len(w), 0.8), vocab) + [rng.choice(vocab) for _ in range(30)]))
    got = {(m[0], m[1]) for m in index.matches(texts)}
    assert sum((i, i) in got for i in range(300)) >= 0.95 * 300


def test_place():
    item = np.array([1, 2, 3, 4])
    assert dc.closest(item, np.array([9, 1, 2, 8, 3, 4, 9])) == (1, 1, 6)


def test_any_similarity():
    """Down to a similarity that leaves no word triple of an item; what is found is right, and planted places are found."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(2000)]
    for similarity in (1.0, 0.9, 0.65, 0.5, 0.3):
        items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 6, 12, 20, 40])]
        index = dc.Index(items, similarity)
        texts = ["", "short text"]
        for _, s in items:
            texts.append(" ".join([*(rng.choice(vocab) for _ in range(20)), s, *(rng.choice(vocab) for _ in range(5))]))
        got = {(m[0], m[1]): m[4] for m in index.matches(texts)}
        assert all(got.get((i + 2, i)) == 0 for i, _ in items)
        assert all(e <= dc.allowed_edits(len(items[i][1].split()), similarity) for (_, i), e in got.items())


def test_unrelated_windows_seldom_meet():
    """Sampling inside the walk: windows without a word of the item share a table's key only by chance."""
    rng = np.random.default_rng(4)
    index = dc.Index([(0, " ".join(f"w{k}" for k in range(20)))])
    windows = rng.integers(1000, 5000, (300, 20))
    table, _ = index.keys[20]
    share = np.isin(index.hashed(windows, 20).reshape(300, -1), table).any(axis=1).mean()
    assert share < 0.1
