"""Evaluation of extraction runs against verified cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcheck.functions import text as X

FIELDS = ("serial_number", "ident", "name", "relation_name", "relation_type", "house", "age", "gender")
#: Fields whose errors are also counted by character and word.
TEXT_FIELDS = ("name", "relation_name")


def _fields(gold: DataFrame, observations: DataFrame) -> list[str]:
    """The fields that both tables have."""
    return [f for f in FIELDS if f in gold.columns and f in observations.columns]


def _joined(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """Every observed case with the gold (g_) and predicted (p_) values of its fields in normal form; '' is none, a null g_ is not evaluated."""
    fields = _fields(gold, observations)
    carried = [c for c in ("failure_code", "retry_count", "runtime_ms", "memory_mb") if c in observations.columns]
    o = observations.select("case_id", "config_id", *carried, *[F.coalesce(X.norm_field(F.col(f).cast("string"), f), F.lit("")).alias(f"p_{f}") for f in fields])
    wanted = [F.when(F.col(f).isNotNull(), F.coalesce(X.norm_field(F.col(f).cast("string"), f), F.lit(""))).alias(f"g_{f}") for f in fields]
    return gold.select("case_id", "part_number", "lang", *wanted).join(o, "case_id")


def compared(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """Gold (g) and predicted (p) value of every case, configuration and field with a gold value, normalised, with edit distances.

    Values are normalised and cases joined before their fields are stacked, so a case crosses the shuffle once. Edits are
    counted for text fields only.
    """
    fields = _fields(gold, observations)
    pairs = ", ".join(f"'{f}', g_{f}, p_{f}" for f in fields)
    j = _joined(gold, observations).select("case_id", "config_id", "part_number", "lang", "failure_code", F.expr(f"stack({len(fields)}, {pairs}) as (field, g, p)")).filter("g is not null")
    text, same = F.col("field").isin(*TEXT_FIELDS), F.col("g") == F.col("p")
    edits = lambda distance: F.when(text & same, 0).when(text, distance)
    return j.withColumns({"char_edits": edits(F.levenshtein("g", "p")), "word_edits": edits(X.token_distance(F.col("g"), F.col("p")))})


def _right() -> Column:
    return (F.col("g") == F.col("p")) & (F.col("g") != "")


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part / F.when(whole > 0, whole), 6)


def _measures() -> list[Column]:
    c = F.col
    text = c("field").isin(*TEXT_FIELDS)
    words = F.size(F.filter(F.split("g", " "), lambda w: w != ""))
    off = F.when(c("field") == "age", F.abs(c("p").try_cast("int") - c("g").try_cast("int")))
    return [
        F.count("*").alias("cases"),
        F.count_if(_right()).alias("correct"),
        F.count_if((c("p") != "") & (c("g") != c("p"))).alias("incorrect"),
        F.count_if(c("p") == "").alias("missing"),
        F.count_if((c("p") == "") & c("failure_code").isNotNull()).alias("failures"),
        _rate(F.count_if(_right()), F.count("*")).alias("accuracy"),
        _rate(F.sum("char_edits"), F.sum(F.when(text, F.length("g")))).alias("cer"),
        _rate(F.sum("word_edits"), F.sum(F.when(text, words))).alias("wer"),
        F.count_if((c("field") == "ident") & (c("p") != "") & ~c("p").rlike(X.IDENT_SHAPE)).alias("bad_idents"),
        F.count(off).alias("parseable_ages"),
        F.round(F.avg(off), 6).alias("age_mae"),
    ]


def field_metrics(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """Per configuration and field; accuracy is over all gold values, cer and wer are of text fields."""
    return compared(gold, observations).groupBy("config_id", "field").agg(*_measures())


def field_metrics_by_edition(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """The same overall (scope `overall`) and for each edition (`language:en` ..) in one pass."""
    rows = compared(gold, observations)
    out = rows.groupingSets([[F.col("config_id"), F.col("field")], [F.col("config_id"), F.col("field"), F.col("lang")]], "config_id", "field", "lang").agg(F.grouping("lang").alias("_all"), *_measures())
    return out.withColumn("scope", F.when(F.col("_all") == 1, "overall").otherwise(F.concat(F.lit("language:"), "lang"))).drop("_all", "lang")


def aggregate_metrics(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """Cards overall, per edition and per part in one pass; the columns not grouped are null.

    A card succeeds if any field was predicted; evaluated and empty fields are those with a gold value; retry_rate is of
    cards, runtime summed, memory the highest. error_classes and retry_impact have the errors.
    """
    c = F.col
    fields = _fields(gold, observations)
    number = lambda x: F.when(x, 1).otherwise(0)
    given = [c(f"g_{f}").isNotNull() for f in fields]
    empty = [g & (c(f"p_{f}") == "") for g, f in zip(given, fields)]
    cards = _joined(gold, observations).select(
        "config_id",
        "lang",
        "part_number",
        "retry_count",
        "runtime_ms",
        "memory_mb",
        F.concat(*[f"p_{f}" for f in fields]).alias("_any"),
        sum(map(number, given), F.lit(0)).alias("evaluated"),
        sum(map(number, empty), F.lit(0)).alias("empty"),
    )
    sets = [[c("config_id")], [c("config_id"), c("lang")], [c("config_id"), c("part_number")]]
    return cards.groupingSets(sets, "config_id", "lang", "part_number").agg(
        F.count("*").alias("cases"),
        F.count_if(c("_any") != "").alias("successful"),
        F.count_if(c("_any") == "").alias("extraction_failures"),
        F.sum("evaluated").alias("evaluated_fields"),
        F.sum("empty").alias("empty_fields"),
        F.count_if(c("retry_count") > 0).alias("retried"),
        _rate(F.count_if(c("retry_count") > 0), F.count("*")).alias("retry_rate"),
        F.sum("runtime_ms").alias("runtime_ms"),
        F.max("memory_mb").alias("memory_mb"),
    )


# fixed values: letters and digits taken for each other, and words of failure codes
CONFUSABLE = ("O0", "0O", "I1", "1I", "S5", "5S", "B8", "8B", "Z2", "2Z")
CROP_CODES = "crop|layout|geometry"
PARSER_CODES = "parse|invalid"


def error_class(gold: Column, predicted: Column, field: Column, lang: Column, failure: Column) -> Column:
    """What kind of error a predicted value is, from normalised values ('' for none); null where it is right."""
    code = F.lower(F.coalesce(failure, F.lit("")))
    spaceless = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    plain = lambda c: F.regexp_replace(c, "(?U)[^\\w\\s]", "")
    swapped = F.exists(F.zip_with(F.split(gold, ""), F.split(predicted, ""), lambda a, b: F.concat(F.upper(a), F.upper(b))), lambda x: F.coalesce(x.isin(*CONFUSABLE), F.lit(False)))
    return (
        F.when((gold == predicted) & (gold != ""), None)
        .when(code.rlike(CROP_CODES), "crop_layout_issue")
        .when(code.rlike(PARSER_CODES), "field_parser_rejection")
        .when(predicted == "", "empty")
        .when(spaceless(gold) == spaceless(predicted), "spacing")
        .when(plain(gold) == plain(predicted), "punctuation")
        .when((F.length(gold) == F.length(predicted)) & swapped, "digit_letter_confusion")
        .when((lang == "te") & field.isin("name", "relation_name"), "script_confusion")
        .otherwise("wrong_character")
    )


def error_classes(gold: DataFrame, observations: DataFrame) -> DataFrame:
    c = compared(gold, observations)
    found = c.withColumn("error", error_class(F.col("g"), F.col("p"), F.col("field"), F.col("lang"), F.col("failure_code")))
    return found.filter("error is not null").groupBy("config_id", "field", "error").agg(F.count("*").alias("n"))


def retry_impact(gold: DataFrame, observations: DataFrame, baseline: str, final: str) -> DataFrame:
    """Per field: cases wrong in the baseline, recovered and still failed in the final run, and newly broken ones."""
    c = compared(gold, observations).withColumn("ok", F.col("g") == F.col("p"))
    stage = lambda s: c.filter(F.col("config_id") == s).select("case_id", "field", F.col("ok").alias(f"{s}_ok"))
    j = stage(baseline).join(stage(final), ["case_id", "field"])
    b, f = F.col(f"{baseline}_ok"), F.col(f"{final}_ok")
    return j.groupBy("field").agg(F.count_if(~b).alias("failed"), F.count_if(~b & f).alias("recovered"), F.count_if(~b & ~f).alias("still_failed"), F.count_if(b & ~f).alias("broken"))


def rank_configs(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """Configurations by ident, serial, Telugu name and mean accuracy, then runtime; an accuracy that was not measured comes last."""
    c = F.col
    metrics = field_metrics_by_edition(gold, observations)
    measured = lambda scope, field: F.coalesce(F.max(F.when((c("scope") == scope) & (c("field") == field), c("accuracy"))), F.lit(-1.0))
    per = metrics.groupBy("config_id").agg(
        measured("overall", "ident").alias("ident_accuracy"),
        measured("overall", "serial_number").alias("serial_number_accuracy"),
        measured("language:te", "name").alias("telugu_name_accuracy"),
        F.round(F.coalesce(F.avg(F.when(c("scope") == "overall", c("accuracy"))), F.lit(-1.0)), 6).alias("mean_accuracy"),
    )
    time = observations.groupBy("config_id").agg(F.sum("runtime_ms").alias("runtime_ms"))
    best = [c(f"{k}_accuracy").desc() for k in ("ident", "serial_number", "telugu_name", "mean")]
    return per.join(time, "config_id").withColumn("place", F.row_number().over(Window.orderBy(*best, "runtime_ms", "config_id")))  # one row a configuration


def check_observations(gold: DataFrame, observations: DataFrame, no_retry: list[str], configs: list[str] | None = None) -> DataFrame:
    """Violations: repeated case and configuration, unknown case, case that a configuration lacks, unknown configuration, retries where none are allowed.

    configs are the known configurations; those met are taken where it is not given.
    """
    c = F.col
    double = observations.groupBy("case_id", "config_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", "config_id", F.lit("repeated").alias("violation"))
    unknown = observations.join(gold.select("case_id"), "case_id", "left_anti").select("case_id", "config_id", F.lit("unknown_case").alias("violation"))
    retried = observations.filter(c("config_id").isin(*no_retry) & (c("retry_count") > 0)).select("case_id", "config_id", F.lit("retry_not_allowed").alias("violation"))
    if configs is None:
        names = observations.select("config_id").distinct()
        foreign = observations.limit(0).select("case_id", "config_id", F.lit("unknown_config").alias("violation"))
    else:
        names = gold.sparkSession.createDataFrame([(x,) for x in configs], "config_id string")
        foreign = observations.filter(~c("config_id").isin(*configs)).select("case_id", "config_id", F.lit("unknown_config").alias("violation"))
    wanted = gold.select("case_id").distinct().crossJoin(F.broadcast(names))  # a configuration is a setting of the run: few
    lacking = wanted.join(observations.select("case_id", "config_id"), ["case_id", "config_id"], "left_anti").select("case_id", "config_id", F.lit("missing_case").alias("violation"))
    return double.unionByName(unknown).unionByName(retried).unionByName(foreign).unionByName(lacking)


POLICY = "scope string, field string, metric string, bound double"
#: Metrics of a policy: those of a field, and those of all cards; accuracy is a least value, the others are most ones.
FIELD_METRICS = {"accuracy": "exact accuracy", "cer": "CER", "wer": "WER"}
CARD_METRICS = {"failure_rate": "extraction failure rate", "empty_rate": "empty rate", "runtime_per_card": "runtime per card"}


def policy_rows(spark: SparkSession, accuracy: dict[str, float], cer: dict[str, float] | None = None, wer: dict[str, float] | None = None, languages: tuple[str, ...] = ("en", "te"), **cards: float) -> DataFrame:
    """A policy as rows (scope, field, metric, bound): field bounds hold overall and for each language, cards' bounds (CARD_METRICS) overall."""
    if unknown := set(cards) - set(CARD_METRICS):
        raise ValueError(f"not a bound: {sorted(unknown)}")
    scopes = ["overall", *[f"language:{x}" for x in languages]]
    fields = [(s, f, m, float(v)) for s in scopes for m, bounds in (("accuracy", accuracy), ("cer", cer or {}), ("wer", wer or {})) for f, v in bounds.items()]
    return spark.createDataFrame(fields + [("overall", None, m, float(v)) for m, v in cards.items()], POLICY)


def measured_rows(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """(config_id, scope, field, metric, value): every figure that a policy can bound, long; unmeasured ones are null."""
    names = list(FIELD_METRICS)
    fields = field_metrics_by_edition(gold, observations).select("config_id", "scope", "field", F.expr(f"stack({len(names)}, {', '.join(f"'{m}', {m}" for m in names)}) as (metric, value)"))
    c = F.col
    cards = aggregate_metrics(gold, observations).filter("lang is null and part_number is null")
    rates = {"failure_rate": c("extraction_failures") / c("cases"), "empty_rate": c("empty_fields") / F.when(c("evaluated_fields") > 0, c("evaluated_fields")), "runtime_per_card": c("runtime_ms") / c("cases")}
    cards = cards.select("config_id", F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("field"), *[x.cast("double").alias(k) for k, x in rates.items()])
    cards = cards.select("config_id", "scope", "field", F.expr(f"stack({len(rates)}, {', '.join(f"'{m}', {m}" for m in rates)}) as (metric, value)"))
    return fields.unionByName(cards)


def policy_breaches(gold: DataFrame, observations: DataFrame, policy: DataFrame) -> DataFrame:
    """(config_id, scope, field, metric, bound, value, reason) of every bound that a configuration breaks or has no figure for.

    A relational division: each configuration is held against all rows of the policy, and passes if none is left here.
    """
    c = F.col
    asked = observations.select("config_id").distinct().crossJoin(F.broadcast(policy))  # a policy is a page of rows
    found = measured_rows(gold, observations).withColumnRenamed("config_id", "_config").withColumnsRenamed({k: f"_{k}" for k in ("scope", "field", "metric")})
    same = [c(k).eqNullSafe(c(f"_{k}")) for k in ("scope", "field", "metric")]
    held = asked.join(found, [c("config_id") == c("_config"), *same], "left").drop("_config", "_scope", "_field", "_metric")
    label = F.lit(None).cast("string")
    for k, text in (FIELD_METRICS | CARD_METRICS).items():
        label = F.when(c("metric") == k, text).otherwise(label)
    verdict = F.when(c("value").isNull(), "is unmeasured").when((c("metric") == "accuracy") & (c("value") < c("bound")), "is below policy").when((c("metric") != "accuracy") & (c("value") > c("bound")), "exceeds policy")
    return held.withColumn("reason", F.when(verdict.isNotNull(), F.concat_ws(" ", "scope", "field", label, verdict))).filter("reason is not null").select("config_id", "scope", "field", "metric", "bound", "value", "reason")


def evidence_blockers(gold: DataFrame, observations: DataFrame, parts: list[int], least_cards: int = 1, least_configs: int = 2) -> DataFrame:
    """(blocker) of what forbids any selection: too few cards or configurations, an edition without cases, parts that are not those required."""
    c = F.col
    cards = gold.agg(F.count("*").alias("cards"), *[F.count_if(c("lang") == x).alias(x) for x in ("en", "te")], F.array_sort(F.collect_set("part_number")).alias("parts"))
    configs = observations.agg(F.countDistinct("config_id").alias("configs"))
    why = {
        "verified case count is below the policy minimum": c("cards") < least_cards,
        "English coverage is missing": c("en") == 0,
        "Telugu coverage is missing": c("te") == 0,
        "coverage is not of the required parts": c("parts") != F.array_sort(F.array(*[F.lit(p) for p in parts]).cast(cards.schema["parts"].dataType)),
        "too few configurations were measured": c("configs") < least_configs,
    }
    found = cards.crossJoin(configs).select(F.explode(F.array_compact(F.array(*[F.when(x, k) for k, x in why.items()]))).alias("blocker"))  # one row each
    return found


def gate_candidates(gold: DataFrame, observations: DataFrame, policy: DataFrame) -> DataFrame:
    """config_id, place, blockers, eligible and selected, in the order of rank_configs: the first without a breach is selected."""
    breaches = policy_breaches(gold, observations, policy).groupBy("config_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ", ").alias("blockers"))
    out = rank_configs(gold, observations).select("config_id", "place").join(breaches, "config_id", "left").select("config_id", "place", F.coalesce("blockers", F.lit("")).alias("blockers"), F.col("blockers").isNull().alias("eligible"))
    first = F.min(F.when(F.col("eligible"), F.col("place"))).over(Window.partitionBy())  # one row a configuration
    return out.withColumn("selected", F.coalesce(F.col("place") == first, F.lit(False)))


def validate_ground_truth(gold: DataFrame) -> DataFrame:
    """Violations of verified cases: repeated slot and edition, ident format, serial and age rules."""
    slot = gold.groupBy("part_number", "serial_number", "lang").agg(F.count("*").alias("n")).filter("n > 1").select("part_number", "serial_number", "lang", F.lit("repeated_slot").alias("violation"))
    c = F.col
    why = F.when(~c("ident").rlike(X.IDENT_SHAPE), "ident_format").when(~X.is_canonical_serial(c("serial_number")), "serial").when(~F.coalesce(c("age").try_cast("int").between(18, 125), F.lit(False)), "age")
    rows = gold.withColumn("violation", why).filter("violation is not null").select("part_number", "serial_number", "lang", "violation")
    return slot.unionByName(rows)


def ground_truth_coverage(gold: DataFrame, parts: DataFrame, target: int = 480) -> DataFrame:
    """Cases on the grid of parts and editions, empty groups too."""
    n = gold.groupBy("part_number", "lang").agg(F.count("*").alias("cases"))
    grid = parts.select("part_number").distinct().withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("te"))))
    return grid.join(n, ["part_number", "lang"], "left").select("part_number", "lang", F.coalesce("cases", F.lit(0)).alias("cases"), (F.coalesce("cases", F.lit(0)) >= target).alias("target_met"))


def _row_hash(report: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}), 256)


def report_manifest(report: DataFrame, digits: int = 3) -> DataFrame:
    """(prefix, rows, sha256): a report's rows by the first `digits` hex digits of their hash, each bucket hashed over its rows' sorted hashes.

    The leaves of a hash tree: 16 ** digits buckets, whatever order the rows come in, and no bucket holds more than its share.
    """
    rows = report.select(_row_hash(report).alias("h"))
    return rows.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))


def manifest_root(manifest: DataFrame) -> DataFrame:
    """One row (rows, sha256) over a manifest's buckets, of which there are few."""
    return manifest.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "sha256"))), lambda r: r["sha256"]), ""), 256).alias("sha256"))


def verify_manifest(report: DataFrame, manifest: DataFrame, digits: int = 3) -> DataFrame:
    """(prefix, was, now) of the buckets that no longer agree with a frozen manifest; none if the report is unchanged.

    A changed row shows in the bucket of its old hash and in that of its new one.
    """
    now = report_manifest(report, digits).select("prefix", F.col("sha256").alias("now"))
    return manifest.select("prefix", F.col("sha256").alias("was")).join(now, "prefix", "full").filter(~F.col("was").eqNullSafe(F.col("now")))


def changed_rows(report: DataFrame, differing: DataFrame, digits: int = 3) -> DataFrame:
    """The report's rows in buckets that differ, which is where a change lies."""
    return report.withColumn("_prefix", F.substring(_row_hash(report), 1, digits)).join(differing.select(F.col("prefix").alias("_prefix")), "_prefix", "left_semi").drop("_prefix")


def report_checksum(report: DataFrame) -> DataFrame:
    """SHA-256 of a report, independent of its rows' order: the root of its hash tree."""
    return manifest_root(report_manifest(report)).select("sha256")
