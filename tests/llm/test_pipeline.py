import corpus_pipeline
from pyspark.sql import functions as F
from rollcheck.llm import decontaminate, language, mixing, simhash


def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir).cache()
        out.append((docs, got))
        docs = got
    return out


def first_of_groups(docs):
    """Smallest ids of the groups that all pairs of five-word Jaccard 0.8 or more make, by comparing all pairs."""
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in docs.collect()]
    sets = [({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for _, w in rows]
    low = [d for d, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (both := len(sets[i] & sets[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return sorted(set(low))


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    first, second, third, fourth, last = stages(spark, sf_dir)
    for _, got in (first, second, third, fourth):
        assert got.columns == corpus_pipeline.COLUMNS
    before, after = first
    clean = before.filter(F.col("text").rlike(r"\p{L}"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in clean.collect()}
    before, after = second
    assert sorted(r.doc_id for r in after.collect()) == first_of_groups(before)
    before, after = third
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = {r.doc_id for r in decontaminate.find_matches(before, items).collect()}
    assert held and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - held
    before, after = fourth
    took = {r.doc_id: r.taken for r in mixing.mix_documents(before).collect()}
    words = after.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == {d: n for d, n in took.items() if n}
    before, after = last
    assert after.count() == before.count()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))


def test_first_of_group_with_ties_and_nulls(spark):
    rows = [(2, "one two three four", "x"), (1, "one two three four", "y"), (1, "one two three four", "y"), (None, "five six seven", "z"), (None, None, "z"), (3, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), str(r.text)) for r in simhash.keep_first(df).collect())
    assert got[0] == ("1", "one two three four") and ("3", "") in got and len(got) == 3
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_label_keeps_columns(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "q"), (2, None, None, "r")], "doc_id long, text string, lang string, mixture string")
    got = language.label(df, language.fit(df)).collect()
    assert [(r.doc_id, r.lang, r.mixture) for r in got] == [(1, "en", "q"), (2, "und", "r")]


def test_edited_copies_of_the_given_table_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert {1, 6} <= kept and not {177, 145} & kept  # Jaccard 0.83 each; fingerprints differ in 11 and 7 bits


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(corpus_pipeline.COLUMNS)
    junk = ["xqzj kkwp zzt qqx vvk wqz", "Съешь ещё этих мягких французских булок", "日本語の文章です"]
    more = spark.createDataFrame([(9000 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), "").collect()}
    assert kept == {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
