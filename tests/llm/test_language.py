import numpy as np
from pyspark.sql import functions as F
from rollcheck.llm import language
from rollcheck.llm.common import fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.filter(fold(F.col("doc_id"), 4) != 2)
    model = language.fit(train)
    got = language.identify(docs, model).join(docs, "doc_id").filter(fold(F.col("doc_id"), 4) == 2)
    rows = got.select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_matches_long_run_of_em():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (language.BUCKETS, 3)).astype(float)
    m = language.Model(["a", "b", "c"], counts)
    p = m.p[:2000]
    n = rng.multinomial(5000, (p @ [0.7, 0.3, 0.0]) / (p @ [0.7, 0.3, 0.0]).sum()).astype(float)
    share, fit = m._proportions(p, n, 500)
    slow = np.full(3, 1 / 3)
    for _ in range(3000):
        resp = p * slow / (p @ slow)[:, None]
        slow = (n[:, None] * resp).sum(0) / n.sum()
    assert np.abs(share - slow).max() < 0.05 and fit <= n @ np.log(p @ slow) + 1e-6


def test_mixed_text_and_edges(spark):
    rows = [(i, t, l) for i in range(40) for t, l in (("the cat and the dog of the house " * 3, "en"), ("der hund und die katze im haus " * 3, "de"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == ["de", "en"]
    mixed = model.mixture("the cat and the dog of the house " * 20 + "der hund und die katze im haus " * 20)
    assert set(mixed) == {"de", "en"} and 0.3 < mixed["en"] < 0.7
    assert list(model.mixture("the dog of the house")) == ["en"]
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 34 !?", 0), (None, "the cat", 0), (4, "der hund " * 50_000, 0), (4, "the", 0)], "doc_id long, text string, score int")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "en")}
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_symbols_beyond_the_basic_plane_are_no_letters():
    assert len(language.ngrams("\U0001f600\U0001f680 \U0001f4a9")[0]) == 0
    assert len(language.ngrams("\U00010400\U00020000")[0])  # Deseret, an ideograph
    for a, b in zip(language.ngrams("the \U0001f600 cat"), language.ngrams("the - cat")):
        assert (a == b).all()
