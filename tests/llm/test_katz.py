import math
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rollcheck.llm import katz


def toks(text):
    return (text or "").encode().lower().split() + [katz.END]


class Brute:
    def __init__(self, texts):
        seqs = [toks(t) for t in texts]
        self.uni = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.pair = Counter((h, w) for s in seqs for h, w in zip([None, *s], s))
        self.hist = Counter(h for (h, w), c in self.pair.items() for _ in range(c))
        d1, d2 = katz.discounts(Counter(self.uni.values())), katz.discounts(Counter(self.pair.values()))
        disc = lambda c, d: c * (d[c] if c < len(d) else 1.0)
        self.p1 = {w: disc(c, d1) / self.n for w, c in self.uni.items()}
        self.p0 = 1 - sum(self.p1.values())
        if self.p0 < 1e-12:
            self.p1, self.p0 = {w: c / (self.n + 1) for w, c in self.uni.items()}, 1 / (self.n + 1)
        self.p2 = {(h, w): disc(c, d2) / self.hist[h] for (h, w), c in self.pair.items()}
        self.after = defaultdict(list)
        for h, w in self.pair:
            self.after[h].append(w)
        self.alpha = {}
        for h, ws in self.after.items():
            mass = sum(self.p2[h, w] for w in ws)
            if 1 - mass < 1e-9:
                for w in ws:
                    self.p2[h, w] *= self.hist[h] / (self.hist[h] + 1)
                mass = self.hist[h] / (self.hist[h] + 1)
            self.alpha[h] = (1 - mass) / (1 - sum(self.p1[w] for w in ws))

    def prob(self, h, w):
        if (h, w) in self.p2:
            return self.p2[h, w]
        return self.alpha.get(h, 1.0) * self.p1.get(w, self.p0)

    def score(self, text):
        s = toks(text)
        return sum(math.log10(self.prob(h, w)) for h, w in zip([None, *s], s))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in toks(text))


def made(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([0, 1, 5, 40])))) for i in range(n)]
    return rows + [(7, "same words"), (7, "same words"), (900, None), (901, " \n"), (None, "W1 é É"), (902, "word " * 30_000)]


def test_scores_equal_brute_force(spark):
    rows = made(1)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, score int")
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    m = Brute([t for d, t in rows if d is not None and d % 3 != 0])
    got = katz.score_texts(df, train, block_bytes=2000).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), len(toks(t)), sum(m.uni[w] > 0 for w in toks(t)), m.n, round(m.base(t), 5), round(m.score(t), 5)) for d, t in rows)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=1e-4)


def test_probabilities_sum_to_one():
    m = Brute([t for _, t in made(2)[:200]])
    for h in [None, *list(m.uni)[:30]]:
        assert abs(sum(m.prob(h, w) for w in m.uni) + m.prob(h, b"never seen") - 1) < 1e-9


def test_few_words_and_no_training(spark):
    rows = [(i, "a b a b a b a b") for i in range(30)] + [(99, "a a b zzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = Brute([t for _, t in rows[:30]])
    got = {r.doc_id: r.score for r in katz.score_texts(df, F.col("doc_id") < 50).collect()}
    assert all(abs(got[d] - m.score(t)) < 1e-6 for d, t in rows)
    none = katz.score_texts(df, F.lit(False)).collect()
    assert len(none) == 31 and all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in none)
    assert katz.score_texts(df.limit(0), F.lit(True)).count() == 0


@given(st.lists(st.integers(0, 2**40), max_size=20), st.lists(st.floats(allow_nan=False), max_size=5))
def test_packing(a, b):
    x, y = katz.unpack(katz.pack(np.array(a, np.uint64), np.array(b, np.float64)))
    assert x.tolist() == a and y.tolist() == b
