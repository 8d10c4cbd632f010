"""Mixing of sources to target weights, with DataFrame functions only.

The words of each source are packed, document after document, into blocks of fixed length; the last
block of a source may be short. The mix is a row of slots. Each output shard draws its slots'
sources by a multinomial with the target weights; what a source draws beyond its target moves to
sources that drew less. A source's k-th slot takes block p(k mod blocks) under a pseudorandom
permutation p of its block numbers, so no block is taken a third time before all are taken twice.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources come to the driver, one row each, where more than this would be refused.
MOST_SOURCES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"
PIECE = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, docs) -> with target: share of all words by weight, none above most x its size.

    Sources at the limit are those with the smallest size per weight, so running sums in that order
    give the level at which the rest share what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    leveled = placed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    at = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(whole)["level"]
    return leveled.withColumn("target", F.least(F.col("limit"), F.coalesce(at, F.col("level")) * F.col("weight"))).select("source", "place", "source_size", "docs", "target")


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) from a hash."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def permuted(df: DataFrame, k: str, n: Column, key: Column, out: str, rounds: int = 3, walks: int = 40) -> DataFrame:
    """Adds out: a pseudorandom permutation of 0 .. n - 1 at k.

    k is split over a grid of h rows of w cells, w = ceil(sqrt(n)) and h = ceil(n / w); keyed sums,
    each half moved by a hash of the other, permute the grid. Its values from n up, fewer than w of
    them, are sent through again: for n to 1600 some walk of at most w = 40 ends below n, and for
    larger n a walk of 40 that doesn't has a chance under (1 / 40) ** 40.
    """
    w, h = F.col("_w"), F.col("_h")
    moved_a = lambda a, b, r: F.pmod(a + F.pmod(F.xxhash64(F.col("_key"), r, b), h), h)
    moved_b = lambda a, b, r: F.pmod(b + F.pmod(F.xxhash64(F.col("_key"), r, a), w), w)

    def shuffled(x: Column) -> Column:
        """The same steps as below in one expression, for the few values that walk."""

        def half(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            return F.struct(F.when(even, moved_a(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved_b(s["a"], s["b"], r)).alias("b"))

        start = F.struct(F.floor(x / w).cast("long").alias("a"), F.pmod(x, w).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, half, lambda s: s["a"] * w + s["b"])

    df = df.withColumn("_n", n).withColumn("_key", key).withColumn("_w", F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("long"))
    df = df.withColumn("_h", F.ceil(F.col("_n") / w).cast("long")).withColumns({"_a": F.floor(F.col(k) / w).cast("long"), "_b": F.pmod(F.col(k), w)})
    for r in range(0, 2 * rounds, 2):
        df = df.withColumn("_a", moved_a(F.col("_a"), F.col("_b"), F.lit(r))).withColumn("_b", moved_b(F.col("_a"), F.col("_b"), F.lit(r + 1)))
    df = df.withColumn("_x", F.col("_a") * w + F.col("_b"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.col("_x"), lambda x, _: F.when(x < F.col("_n"), x).otherwise(shuffled(x)))
    return df.withColumn(out, F.when(F.col("_x") < F.col("_n"), F.col("_x")).otherwise(again)).drop("_n", "_key", "_w", "_h", "_a", "_b", "_x")


def _running(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of value over the rows before, within group, by chunk and then order.

    The column chunk deals a group over many tasks: sums run within chunks and over chunk totals,
    so no task sees a whole group, however large.
    """
    inside = Window.partitionBy(group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, "chunk").agg(F.sum(value).alias("_sum")).select(group, "chunk", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, [group, "chunk"]).withColumn(name, F.col("_in") + F.col("_base")).drop("_in", "_base")


def _chunks(n: Column) -> Column:
    """Chunks for n rows: about the root of n, so chunks and their rows grow alike."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")


class Mix:
    """One mix of a table: sources (source, place, source_size, docs, target, blocks, slots), documents and slots.

    docs: id, source, text, size, place and start (words of its source before it).
    slots: shard, slot, place, block: what the mix takes, in order. Reruns give the same rows.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 32, shard_slots: int = 2048, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> None:
        spark = docs.sparkSession
        self.block_words, self.most = block_words, int(most)
        rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)])
        self.kept = [f"_keep_{k}" for k in range(len(keep))]
        texts, rows = rows.withColumn("tie", F.xxhash64("text")), cut(rows.select("id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        per = F.col("source_size") / block_words
        blocks = F.ceil(per).cast("long")
        sized = source_targets(sizes, weights, share, most).withColumn("blocks", blocks)
        # a source's blocks are all full but for the last; slots follow the target as a share of its blocks
        wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(F.lit(0)).cast("long")
        self.sources = cut(sized.withColumn("slots", F.least(wanted, F.col("blocks") * self.most)))
        known = self.sources.orderBy("place").limit(MOST_SOURCES + 1).collect()
        if len(known) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        slots = [r.slots for r in known]
        total = sum(slots)

        small = self.sources.select(F.col("source").alias("_source"), "place", "docs")
        with_place = lambda df: df.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        placed = with_place(rows).withColumn("chunk", F.pmod(F.xxhash64("id", "tie"), _chunks(F.col("docs"))))
        self.docs = _running(placed, "place", ["id", "tie"], "size", "start").select("id", "tie", "source", "place", "size", "start")
        self.texts = with_place(texts).select("id", "tie", "place", "text", *self.kept)

        # multinomial draws of the shards' slots
        bounds = [x / total for x in accumulate(slots)] if total else []
        steps = F.array(*[F.lit(b) for b in bounds[:-1]]).cast("array<double>")
        drawn = spark.range(total).withColumn("shard", F.floor(F.col("id") / shard_slots)).withColumn("u", _uniform(seed, F.col("id")))
        drawn = drawn.select(F.col("id").alias("slot"), "shard", F.size(F.filter(steps, lambda b: b <= F.col("u"))).alias("place"))
        counts = cut(drawn.groupBy("shard", "place").agg(F.count("*").alias("n")))
        per_shard = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("base", F.coalesce(F.sum("n").over(per_shard), F.lit(0))).select("shard", "place", "base")
        inside = Window.partitionBy("shard", "place").orderBy("slot")
        ranked = drawn.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["shard", "place"]).withColumn("k", F.col("rank") + F.col("base"))
        got = {r.place: r.n for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # one row a source
        short = [max(0, s - got.get(p, 0)) for p, s in enumerate(slots)]
        table = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]).cast("array<long>"), (F.col("place") + 1).cast("int"))
        taken = ranked.filter(F.col("k") < table(slots or [0])).select("shard", "slot", "place", "k")
        over = ranked.filter(F.col("k") >= table(slots or [0])).select("shard", "slot", "place", "k")
        # overdrawn slots, numbered by source and rank, fill what other sources drew too little of
        beyond = [max(0, got.get(p, 0) - s) for p, s in enumerate(slots)]
        over = over.withColumn("i", F.col("k") - table(slots or [0]) + table([0, *accumulate(beyond)]))
        ends = F.array(*map(F.lit, accumulate(short))).cast("array<long>")
        moved = over.withColumn("place", F.size(F.filter(ends, lambda e: e <= F.col("i"))))
        first = [got.get(p, 0) - x for p, x in enumerate([0, *accumulate(short)][:-1])]
        moved = moved.withColumn("k", F.col("i") + table(first or [0])).select("shard", "slot", "place", "k")
        of_source = self.sources.select("place", F.greatest(F.lit(1), "blocks").alias("_blocks"))
        chosen = taken.unionByName(moved).join(F.broadcast(of_source), "place").withColumn("at", F.pmod(F.col("k"), F.col("_blocks")))
        self.slots = permuted(chosen, "at", F.col("_blocks"), F.hash(F.lit(seed), F.col("place")), "block").select("shard", "slot", "place", "block")

    def pieces(self) -> DataFrame:
        """(id, tie, source, place, start, block, begin, words): the part of each document in each block, begin in the document's words."""
        b = self.block_words
        last = F.floor((F.col("start") + F.col("size") - 1) / b)
        each = self.docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), last)))
        begin = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
        end = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
        return each.select("id", "tie", "source", "place", "start", "block", begin.alias("begin"), (end - begin).alias("words"))

    def uses(self) -> DataFrame:
        """(place, block, times) of every block that the mix takes."""
        return self.slots.groupBy("place", "block").agg(F.count("*").alias("times"))

    def rows(self) -> DataFrame:
        """The mix: shard, slot, place, block, source, id, begin, words; a slot has a row for each document in its block."""
        return self.slots.join(self.pieces(), ["place", "block"])

    def texts_taken(self) -> DataFrame:
        """(id, source, text): a row for each document of which the mix takes words: its first-taken words in order, then those taken again.

        White space stays with the words, so a document taken once and whole keeps its text.
        """
        took = self.pieces().join(self.uses(), ["place", "block"]).groupBy("id", "tie", "source", "place", "start").agg(F.array_sort(F.collect_list(F.struct("begin", "words", "times"))).alias("parts"))
        joined = took.join(self.texts.dropDuplicates(["id", "tie", "place"]), ["id", "tie", "place"])
        words = joined.select("id", "source", *self.kept, "parts", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)).alias("_w"))
        turn = lambda t: F.array_join(F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= t), lambda p: F.slice("_w", (p["begin"] + 1).cast("int"), p["words"].cast("int")))), "")
        return words.select("id", "source", *self.kept, F.concat_ws("\n", turn(1), *[F.nullif(turn(t), F.lit("")) for t in range(2, self.most + 1)]).alias("text"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document.

    taken: its words in the mix, repeats counted, at most `most` times size. A source without words
    has target 0. Null texts have size 0; null sources are one source, the last; a null id comes
    last. Repeated rows are documents of their own. An empty table gives an empty result.
    """
    mix = Mix(docs, **options)
    took = mix.pieces().join(mix.uses(), ["place", "block"]).groupBy("place", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # where a document has words, its place and start are its own
    keyed = mix.docs.withColumn("_start", F.when(F.col("size") > 0, F.col("start")))
    joined = keyed.join(took.withColumnRenamed("start", "_start"), ["place", "_start"], "left").join(F.broadcast(mix.sources.select("place", "source_size", "target")), "place")
    return joined.select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """id, text (the words that the mix takes), source and the columns in keep, for each document of which it takes words.

    Columns in keep come from a document with the same id, text and source.
    """
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keep=tuple(keep), **options)
    return mix.texts_taken().select(F.nullif("id", F.lit(LAST_ID)).alias(id_col), F.col("text").alias(text_col), F.col("source").alias(source_col), *[F.col(k).alias(c) for k, c in zip(mix.kept, keep)])
