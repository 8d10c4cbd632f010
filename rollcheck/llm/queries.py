"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, katz, language, media, mixing, phrases, pii, runs, secrets, simhash, suffix, tokens
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _spans(found: DataFrame, base_kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digest of the base kinds and all spans as one text."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*base_kinds)), written), ",")
    return found.select("doc_id", *map(count, base_kinds), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", written), ",").alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(pii.personal_data(_table(spark, sf_dir, "documents")), pii.BASE)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    found = katz.score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """In a tenth of the documents, chosen by the crc32 of their id, the words from some place on repeat with one period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    found = found.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    found = found.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return found.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_planted(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", longest)
    start, length, period = -F.col("top.before"), F.col("top.length"), -F.col("top.short")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * top.length div -top.short").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secrets.secrets(_table(spark, sf_dir, "documents")), secrets.BASE)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select lang, row_number() over () as piece, regexp_extract_all(part, '[^\x20\x09]+') as ws
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as part
        from documents)),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from pieces),
grams as (
  select lang, k, ws[i:i + k - 1] as key, count(*) as f
  from starts, (values (1), (2), (3), (4)) v(k)
  where i + k - 1 <= len(ws)
  group by all),
totals as (select lang, cast(sum(f) as bigint) as n from grams where k = 1 group by lang),
freq as (select * from grams where f >= 30),
cand as (select * from freq where k > 1),
inside as (
  select lang, key[i:i + m - 1] as key, max(f) as held
  from cand, (values (2), (3)) v(m), (values (1), (2), (3)) u(i)
  where m < k and i + m - 1 <= k
  group by all),
kept as (
  select c.* from cand c left join inside using (lang, key)
  where held is null or 100 * held::hugeint < 80 * c.f::hugeint),
cuts as (
  select c.lang, c.key, c.f as a, j, l.f as l, r.f as r, (2000000::hugeint * c.f) // (l.f::hugeint + r.f) as score
  from kept c, (values (1), (2), (3)) v(j), freq l, freq r
  where j < c.k and l.lang = c.lang and r.lang = c.lang and l.key = c.key[1:j] and r.key = c.key[j + 1:c.k]),
best as (select *, row_number() over (partition by lang, key order by score, j) as nth from cuts),
named as (select lang, array_to_string(key, ' ') as phrase, a, l, r, cast(score as bigint) as score from best where nth = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return {"op13_collocations": OP13_SQL}
