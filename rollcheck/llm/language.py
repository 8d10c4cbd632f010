"""Language identification as inference of a mixture.

Each language has a smoothed distribution over hashed n-grams of letters. A document is a mixture of
languages; expectation-maximisation finds the proportions that make its n-grams most likely, and a
language stays in the mixture only if it raises the likelihood by more than a penalty that grows
with the logarithm of the document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, small_batches, texts

UNKNOWN = "und"
#: n-grams fall into this many buckets, so the model's size is fixed: buckets x languages.
BUCKETS = 1 << 16
MOST_LANGUAGES = 512
#: A text is in no learned language if its log-likelihood for each n-gram lies more than this below its language's level;
#: a text of n n-grams is given SHORT / sqrt(n) more.
MARGIN = 2.0
SHORT = 6.0
_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built from Python's character data once a worker."""
    if "t" not in _LETTER:
        _LETTER["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER["t"]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's 1- to 3-grams of lower-case letters; other characters part words."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    x = np.where(letter, code, 32).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one space between words
    x = np.concatenate(([32], x[keep], [32])).astype(np.uint64)
    two = x[:-1] << np.uint64(21) | x[1:]
    three = two[:-1] << np.uint64(21) | x[2:]
    grams = np.concatenate((x[x != 32], two, three))
    h = (grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    return seen, counts[seen].astype(np.float64)


class Model:
    """languages, and log-likelihood-ready probabilities (bucket, language)."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> None:
        self.languages = languages
        p = counts + smoothing
        self.p = (p / p.sum(0)).astype(np.float64) if len(languages) else p
        self.levels: dict[str, float] = {}

    def mixture(self, text: str, penalty: float = 3.0, rounds: int = 30) -> dict[str, float]:
        """Proportions of the languages kept for a text; empty if it has no letters or there is no language."""
        return self.inferred(text, penalty, rounds)[0]

    def known(self, text: str) -> dict[str, float]:
        """The mixture of a text; empty also where it fits clearly worse than the labelled texts of its main language."""
        mixture, fit, n = self.inferred(text)
        if mixture and fit < self.levels.get(max(mixture, key=mixture.get), -np.inf) - MARGIN - SHORT / n**0.5:
            return {}
        return mixture

    def inferred(self, text: str, penalty: float = 3.0, rounds: int = 30) -> tuple[dict[str, float], float, float]:
        """A text's mixture, its log-likelihood for each n-gram and the number of n-grams."""
        seen, counts = ngrams(text)
        if not len(seen) or not self.languages:
            return {}, 0.0, 0.0
        p, n = self.p[seen], counts.sum()
        cost = penalty * np.log(max(n, 2.0))
        fits = counts @ np.log(p)
        chosen = [int(fits.argmax())]
        best = fits.max()
        share = np.ones(1)
        order = np.argsort(-self._proportions(p, counts, rounds)[0], kind="stable").tolist() if len(self.languages) > 1 else []
        for k in order:  # languages by their share of the full mixture
            if k in chosen:
                continue
            trial = chosen + [k]
            part, fit = self._proportions(p[:, trial], counts, rounds)
            if fit - best <= cost:
                break
            chosen, best, share = trial, fit, part
        return {self.languages[k]: float(s) for k, s in zip(chosen, share)}, float(best / n), float(n)

    @staticmethod
    def _proportions(p: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1 / p.shape[1])
        weight = counts / counts.sum()
        for _ in range(rounds):
            new = share * (p.T @ (weight / (p @ share)))
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-3:
                break
        return share, float(counts @ np.log(p @ share))


def fit(docs: DataFrame, most_docs: int = 4000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", levels: bool = False) -> Model:
    """A model from labelled documents; per language about most_docs of them, chosen by a hash of their id.

    With levels it also learns how well each language's texts fit, which label reads.

    The n-gram counts of the chosen documents are whole. Rows without a label are not used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).filter("lang is not null")
    known = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r.lang for r in known]
    index = {l: k for k, l in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    quota = F.create_map(*[F.lit(x) for r in known for x in (r.lang, min(1.0, most_docs / r.n))])
    chosen = named.filter(F.pmod("h", F.lit(1_000_000)) < quota[F.col("lang")] * 1_000_000).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, l in zip(texts(b), b.column(1).to_pylist()):
                seen, n = ngrams(t)
                total.setdefault(l, np.zeros(BUCKETS))[seen] += n
        for l, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(seen)), pa.array(seen), pa.array(n[seen].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(languages)))
    # at most buckets x languages rows
    for r in chosen.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket, index[r.lang]] = r.n
    model = Model(languages, counts)
    if levels:
        model.levels = _levels(chosen, model)
    return model


def _levels(chosen: DataFrame, model: Model) -> dict[str, float]:
    """By language, the log-likelihood for each n-gram that all but a thousandth of its labelled texts reach."""
    sent = chosen.sparkSession.sparkContext.broadcast(model)  # buckets x languages, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = [sent.value.inferred(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f if n else None for _, f, n in fits], pa.float64())], names=["lang", "fit"])

    # one row a language
    found = chosen.mapInArrow(run, "lang string, fit double").groupBy("lang").agg(F.percentile_approx("fit", 0.001, 10_000).alias("level")).collect()
    return {r.lang: r.level for r in found if r.level is not None}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture): the largest share's language, that share, and all shares.

    Ties go to the language found first. A null text, or one without letters, is `und` with score 0
    and an empty mixture; so is everything if the model knows no language. Repeated rows stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # buckets x languages, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            mixtures = [m.mixture(t) for t in texts(b)]
            top = [max(x.items(), key=lambda i: i[1]) if x else (UNKNOWN, 0.0) for x in mixtures]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([l for l, _ in top], pa.string()), pa.array([min(1.0, s) for _, s in top], pa.float64()), pa.array([list(x.items()) for x in mixtures], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def label(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, with the predicted language (or `und`) in lang_col.

    A text that fits no language of a model with levels is `und` too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mixtures = [sent.value.known(t) for t in texts(b, text_col)]
            top = pa.array([max(x, key=x.get) if x else UNKNOWN for x in mixtures], pa.string())
            yield b.set_column(at, b.schema.field(at).with_type(pa.string()), top)

    return docs.withColumn(lang_col, F.col(lang_col).cast("string")).mapInArrow(run, docs.withColumn(lang_col, F.col(lang_col).cast("string")).schema)
