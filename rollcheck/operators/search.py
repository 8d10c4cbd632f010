"""Search over records and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcheck.functions import text as X
from rollcheck.operators.paging import offset_page, with_total
from rollcheck.operators.registry import active_records, once


def apply_filters(df: DataFrame, **filters) -> DataFrame:
    """Only the filters that are given, so each can reach the scan."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def name_score(name: Column, query: Column | str, ascii_only: bool = False) -> Column:
    """100 equal, 96 holding the query, else trigram similarity in percent to one decimal."""
    q = F.lit(query) if isinstance(query, str) else query
    left, right = X.norm_text(name, ascii_only), X.norm_text(q, ascii_only)
    return F.when(left == right, 100.0).when(left.contains(right), 96.0).otherwise(F.round(X.trigram_similarity(left, right).cast("decimal(10,6)") * 100, 1).cast("double"))


def search_names(df: DataFrame, column: str, query: str, fuzzy: bool = True, ascii_only: bool = False) -> DataFrame:
    """Rows scoring at least 72, or 96 without fuzzy."""
    return df.withColumn("score", name_score(F.col(column), query, ascii_only)).filter(F.col("score") >= (72 if fuzzy else 96))


def rank_text(df: DataFrame, made: str, name: str, query: str, fuzzy: bool = True) -> DataFrame:
    """Rows whose text matches, with the column `made`: struct(score, kind) of an exact, partial, transliteration or fuzzy match."""
    left, right = F.col(f"{made}_l"), X.norm_text(F.lit(query))
    latin_l, latin_r = F.col(f"{made}_r"), X.romanize(F.lit(query))
    df = once(df, **{f"{made}_l": X.norm_text(F.col(name)), f"{made}_r": X.romanize(F.col(name))})

    def alike(a: Column, b: Column) -> Column:
        """Similarity of two texts in normal form; one of under 0.7 is at most the ratio of their lengths, so it is not worked out where that is less."""
        ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
        return F.when(ratio < 0.7, ratio).otherwise(X.similarity(a, b, True))

    best = F.round(F.greatest(alike(left, right), alike(latin_l, latin_r)) * 100)
    match = lambda score, kind: F.struct(score.cast("double").alias("score"), F.lit(kind).alias("kind"))
    same = (latin_l != "") & (latin_r != "") & (latin_l.contains(latin_r) | latin_r.contains(latin_l))
    out = F.when(left == "", None).when(left == right, match(F.lit(100), "exact")).when(left.contains(right), match(F.lit(96), "partial")).when(same, match(F.lit(92), "transliteration"))
    out = out.when(best >= 72, match(best, "fuzzy")) if fuzzy and len(query) >= 3 else out
    return once(df, **{made: out}).filter(F.col(made).isNotNull()).drop(f"{made}_l", f"{made}_r")


KINDS = ("exact", "partial", "transliteration", "fuzzy")
WEIGHTS = {"name": 6, "father": 7, "mother": 7, "husband": 7, "house": 8, "age": 5, "gender": 4, "ident": 10, "serial": 9}
_RELATIVES = {"father": "Father", "mother": "Mother", "husband": "Husband"}


def rank_records(df: DataFrame, filters: dict, fuzzy: bool = True, tolerance: int = 0) -> DataFrame:
    """Records that meet every given filter, with score, match_type (the weakest) and explanation.

    filters may hold part, edition and the keys of WEIGHTS. Names are matched exactly, in part, by
    transliteration or nearly (see rank_text), a relative's name only under its relation; an age within the
    tolerance; house, gender, ident and serial in normal form. The score is the weighted mean of the
    filters' scores, 100 without any. Columns read: name, relation_type, relation_name, house, age,
    gender, ident, serial_number, part_number, lang.
    """
    unknown = set(filters) - set(WEIGHTS) - {"part", "edition"}
    if unknown:
        raise ValueError(f"unsupported filters: {sorted(unknown)}")
    given = {k: v for k, v in filters.items() if v not in (None, "")}
    out = apply_filters(df, part_number=given.get("part"), lang=given.get("edition"))
    full = lambda: F.struct(F.lit(100.0).alias("score"), F.lit("exact").alias("kind"))
    terms: list[tuple[str, Column]] = []
    named: list[str] = []
    for key in ("name", *_RELATIVES):
        if key in given:
            if key != "name":
                out = out.filter(F.col("relation_type") == _RELATIVES[key])
            named.append(key)
    if "house" in given:
        terms.append(("house", F.when(X.norm_house(F.col("house")) == X.norm_house(F.lit(str(given["house"]))), full())))
    if "age" in given:
        gap = F.abs(F.col("age") - int(given["age"]))
        near = F.struct(F.greatest(F.lit(85.0), 100.0 - gap * 5).alias("score"), F.lit("partial").alias("kind"))
        terms.append(("age", F.when(gap == 0, full()).when(gap <= tolerance, near)))
    for key, column in (("gender", "gender"), ("ident", "ident"), ("serial", "serial_number")):
        if key in given:
            terms.append((key, F.when(X.norm_text(F.col(column)) == X.norm_text(F.lit(str(given[key]))), full())))
    if not terms and not named:
        return out.withColumns({"score": F.lit(100.0), "match_type": F.lit("exact"), "explanation": F.array().cast("array<struct<field:string,score:double,kind:string>>")})
    for key, term in terms:
        out = once(out, **{f"_{key}": term}).filter(F.col(f"_{key}").isNotNull())
    for key in named:  # texts last, each on the rows that the filters before it leave
        out = rank_text(out, f"_{key}", "name" if key == "name" else "relation_name", str(given[key]), fuzzy)
    keys = [*named, *(k for k, _ in terms)]
    explained = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"_{k}.score").alias("score"), F.col(f"_{k}.kind").alias("kind")) for k in keys])
    score = F.round(sum((F.col(f"_{k}.score") * WEIGHTS[k] for k in keys), F.lit(0.0)) / sum(WEIGHTS[k] for k in keys))
    weakest = F.greatest(F.lit(1), *[F.array_position(F.array(*map(F.lit, KINDS)), F.col(f"_{k}.kind")).cast("int") for k in keys])
    return out.withColumns({"score": score, "match_type": F.element_at(F.array(*map(F.lit, KINDS)), weakest), "explanation": explained}).drop(*[f"_{k}" for k in keys])


RELATIONS = ("Father", "Mother", "Husband", "Guardian", "Other", "Unknown")


def _tenths(value: Column, query: str) -> Column:
    """Score of a text in tenths: 1000 equal, 960 holding the query, else trigram similarity, half up in whole numbers."""
    q = F.lit(query)
    x, y = X.trigrams(value), X.trigrams(q)
    k, m = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    near = F.when(m > 0, F.floor((2000 * k + m) / (2 * m))).otherwise(0)
    return F.when(value == q, 1000).when(value.contains(q), 960).otherwise(near).cast("int")


def search_records(
    records: DataFrame,
    documents: DataFrame,
    part: int | None = None,
    edition: str = "en",
    name: str | None = None,
    relation_name: str | None = None,
    relation_type: str | None = None,
    house: str | None = None,
    age: int | None = None,
    gender: str | None = None,
    ident: str | None = None,
    serial: str | None = None,
    fuzzy: bool = True,
) -> DataFrame:
    """Records of active documents that meet the filters, with match_score (null without a text filter); see search_page.

    Name and relation weigh 6, house 8; each given text must score 72, or 96 without fuzzy. Records are
    searched with their corrections applied (see review.apply_corrections).
    """
    if edition not in ("en", "te", "ur"):
        raise ValueError(f"unsupported edition: {edition}")
    if relation_type is not None and relation_type not in RELATIONS:
        raise ValueError(f"unsupported relation type: {relation_type}")
    if age is not None and not 18 <= age <= 125:
        raise ValueError(f"unsupported age: {age}")
    blank = lambda v: v is None or not v.strip()
    out = apply_filters(active_records(records, documents), part_number=part, lang=edition, relation_type=relation_type, age=age)
    for column, value, form in (("gender", gender, F.lower), ("ident", ident, F.upper), ("serial_number", serial, lambda c: c)):
        if not blank(value):
            out = out.filter(form(F.trim(column)) == form(F.lit(value.strip())))
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    texts = []
    if not blank(name):
        texts.append((6, _tenths(low("name"), name.strip().lower())))
    if not blank(relation_name):
        texts.append((6, _tenths(low("relation_name"), relation_name.strip().lower())))
    if not blank(house):
        texts.append((8, _tenths(F.regexp_replace(low("house"), "\\s+", ""), "".join(house.split()).lower())))
    if not texts:
        return out.withColumn("match_score", F.lit(None).cast("decimal(18,1)"))
    out = out.withColumns({f"_t{i}": t for i, (_, t) in enumerate(texts)})
    for i in range(len(texts)):
        out = out.filter(F.col(f"_t{i}") >= (720 if fuzzy else 960))
    weight = sum(w for w, _ in texts)
    total = sum((F.col(f"_t{i}") * w for i, (w, _) in enumerate(texts)), F.lit(0))
    tenths = F.floor((2 * total + weight) / (2 * weight))
    return out.withColumn("match_score", (tenths.cast("decimal(17,0)") / 10).cast("decimal(18,1)")).drop(*[f"_t{i}" for i in range(len(texts))])


def search_page(found: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of search_records in rank order, 1 to 100 rows, with the total of all that was found."""
    number = F.when(F.col("serial_number").rlike("^[0-9]+$"), F.col("serial_number").try_cast("int"))
    order = [F.col("match_score").desc_nulls_last(), F.col("part_number"), number.asc_nulls_last(), F.col("serial_number"), F.col("record_id")]
    return with_total(offset_page(found, order, min(max(limit, 1), 100), max(offset, 0)), found)


def blocked_fuzzy_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float = 0.72) -> DataFrame:
    """(left_text, right_text, similarity) of all different texts with a trigram similarity of at least `least`.

    Equal texts are one row on each side, so copies don't multiply; text_members names the rows behind them. A pair at the
    threshold must share one of its rarest trigrams: with n trigrams at most n - ceil(least * n) can
    miss, so each side is sent by its n - ceil(least * n) + 1 rarest only, and common trigrams seldom
    meet. Rarity is counted over both sides; no trigram is dropped.
    """
    sets = lambda df, text: df.select(F.col(text).alias("t")).filter("t is not null").distinct().withColumn("g", X.trigrams(F.col("t"))).filter("size(g) > 0")
    a, b = sets(left, left_text), sets(right, right_text)
    seen = a.select("t", "g").unionByName(b.select("t", "g")).select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("n"))

    def rare(df: DataFrame) -> DataFrame:
        ranked = df.select("t", F.size("g").alias("m"), F.explode("g").alias("x")).join(seen, "x").groupBy("t", "m").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
        keep = F.col("m") - F.ceil(F.col("m") * least) + 1
        return ranked.select("t", "m", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("s")).select("t", "m", "s.x")

    p, q = rare(a).select("x", F.col("t").alias("lt"), F.col("m").alias("lm")), rare(b).select("x", F.col("t").alias("rt"), F.col("m").alias("rm"))
    met = p.join(q, "x").filter((F.least("lm", "rm") >= F.ceil(F.greatest("lm", "rm") * least))).select("lt", "rt").distinct()
    close = met.withColumn("similarity", X.trigram_similarity(F.col("lt"), F.col("rt"))).filter(F.col("similarity") >= least)
    return close.select(F.col("lt").alias("left_text"), F.col("rt").alias("right_text"), "similarity")


def text_members(df: DataFrame, id_col: str, text_col: str, pairs: DataFrame, side: str) -> DataFrame:
    """(text, id): which rows stand behind the texts of one side of blocked_fuzzy_join's pairs."""
    rows = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    return rows.join(pairs.select(F.col(f"{side}_text").alias("text")), "text", "left_semi")
