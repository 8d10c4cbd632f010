"""Phrases of two to four words that hold together, counted by broadcast tries.

Texts are cut into words once: each block of one language's text becomes its sorted 64-bit word codes and the
place of every word among them, written to the shared folder. Then come passes over the blocks, one for each
phrase length and shard of candidates. A pass hands the double-array trie of its candidates to all executors as a
file of the shared folder, which the driver never holds in memory; numpy moves the states of all text positions through it level by level, counts the positions that end in an
accepting state, and the counts of all tasks are summed. The same pass finds the next candidates: phrases one
word longer whose two parts are both candidates (no phrase can be frequent otherwise), kept where their
occurrences in all tasks reach the least count.

A shard holds SHARD candidates whatever the corpus, so a trie is bounded; more candidates mean more passes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, shuffled, small_batches, small_bytes, texts

#: Most candidates of a trie, about; a trie of four-word phrases has some 10 slots of 8 bytes for each.
SHARD = 500_000
#: Positions that a task gathers before it sums and passes on the counts of longer phrases.
GATHER = 1_000_000
#: Groups that counts are dealt to, at least; more words have more, so that a group stays near GATHER positions.
DEALS = 256
#: Bytes of a batch that a task takes in.
BYTES = 8 << 20
#: Words are handed to the trie in digits of so many bits, which keeps each node's children few.
DIGIT = 4
UNKNOWN = "und"

_STOPS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Words of the batch by language; b"." stands between pieces and between texts, as no word holds a stop."""
    by_lang: dict[str, list[bytes]] = {}
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    for lang, text in zip(langs, texts(batch)):
        by_lang.setdefault(lang, []).append(text.encode().lower())
    for lang, parts in by_lang.items():
        yield lang, _STOPS.sub(b" . ", b" . ".join(parts)).split()


def _code(salt: int, lang: str, word: bytes) -> int:
    """The code that Spark's xxhash64(lang, word) gives where salt is 42."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), salt))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words in _pieces(b):
                c = Counter(words)
                c.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([w.decode() for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _coded(words: DataFrame) -> tuple[DataFrame, int]:
    """Adds code, different for all words and never 0, and gives its salt; salts are tried until that holds."""

    def codes(salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [_code(salt, lang, w.encode()) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*b.schema.names, "code"])

        return run

    for salt in range(42, 142):
        found = words.mapInArrow(codes(salt), "lang string, word string, n long, code long")
        clash = found.groupBy("code").count().filter((F.col("count") > 1) | (F.col("code") == 0))
        if clash.isEmpty():
            return found, salt
    raise ValueError("words outnumber what 64-bit codes can tell apart")


def _blocks(docs: DataFrame, salt: int) -> DataFrame:
    """(lang, codes, places): sorted word codes of some texts and each word's place among them; code 0 parts pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words in _pieces(b):
                at = {w: k for k, w in enumerate(dict.fromkeys(words))}
                codes = np.array([0 if w == b"." else _code(salt, lang, w) for w in at], np.uint64)
                order = np.argsort(codes)
                place = np.empty(len(codes), np.uint16 if len(codes) <= 1 << 16 else np.uint32)
                place[order] = np.arange(len(codes))
                places = place[np.array([at[w] for w in words], np.int64)] if words else place
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([codes[order].tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary())], names=["lang", "codes", "places"])

    return docs.mapInArrow(run, "lang string, codes binary, places binary")


class Trie:
    """A double array over word phrases of one length: the child of state s by digit d is t = base[s] + d if check[t] == s.

    Words are numbered by the place of their code in `symbols`, numbers are written in a fixed count of digits.
    State 0 is the root; accepting states are those at full depth.
    """

    def __init__(self, phrases: np.ndarray, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(1)
        self.words = phrases.shape[1]
        self.symbols = np.unique(phrases)
        number = np.searchsorted(self.symbols, phrases)
        self.digits = max(1, -(-int(len(self.symbols) - 1).bit_length() // DIGIT))
        shifts = DIGIT * np.arange(self.digits - 1, -1, -1)
        path = (number[:, :, None] >> shifts & (1 << DIGIT) - 1).reshape(len(phrases), -1)
        path = path[np.lexsort(path.T[::-1])]
        # a row starts a new node at every depth from the first digit in which it differs from the row before
        fresh = np.ones(path.shape, bool)
        fresh[1:] = np.logical_or.accumulate(path[1:] != path[:-1], axis=1)
        size = 2 * int(fresh.sum()) + (4 << DIGIT)
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.check[0] = -2
        state = np.zeros(len(path), np.int64)
        for depth in range(path.shape[1]):
            rows = np.flatnonzero(fresh[:, depth])
            slots = self._place(state[rows], path[rows, depth], rng)
            state = slots[np.cumsum(fresh[:, depth]) - 1]

    def _place(self, parents: np.ndarray, digits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Finds a base for each parent at which all its children fall on free slots; parents with many children come first."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        width = np.diff(np.r_[starts, len(parents)])
        slots = np.empty(len(parents), np.int64)
        for low, high in ((9, 16), (5, 8), (3, 4), (2, 2), (1, 1)):
            left = np.flatnonzero((width >= low) & (width <= high))
            misses = 0
            while len(left):
                if misses > 40:  # the array is too full for these
                    more = max(len(self.base) // 2, 4 << DIGIT)
                    self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                    self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                    misses = 0
                n = width[left]
                first = np.cumsum(n) - n
                edge = np.repeat(starts[left] - first, n) + np.arange(n.sum())
                tried = rng.integers(0, len(self.base) - (1 << DIGIT), len(left))
                slot = np.repeat(tried, n) + digits[edge]
                ok = self.check[slot] == -1
                once = np.zeros(len(slot), bool)
                once[np.unique(slot, return_index=True)[1]] = True
                good = np.logical_and.reduceat(ok & once, first)
                taken = np.repeat(good, n)
                self.base[parents[starts[left[good]]]] = tried[good]
                self.check[slot[taken]] = parents[edge[taken]]
                slots[edge[taken]] = slot[taken]
                left, misses = left[~good], misses + 1 if good.sum() * 8 < len(left) else 0
        return slots

    def step(self, states: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more word, and which rows got there."""
        alive = np.arange(len(states))
        for shift in range(DIGIT * (self.digits - 1), -1, -DIGIT):
            t = self.base[states] + (numbers >> shift & (1 << DIGIT) - 1)
            ok = self.check[t] == states
            states, numbers, alive = t[ok], numbers[ok], alive[ok]
        return states, alive

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code, -1 for words of no candidate."""
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == codes, at, -1).astype(np.int32)

    def accepted(self, of_place: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a candidate starts, and the accepting states there."""
        # the first word is stepped once for each different word, not for each position
        known = np.flatnonzero(of_place >= 0)
        states, alive = self.step(np.zeros(len(known), np.int32), of_place[known])
        after = np.full(len(of_place), -1, np.int32)
        after[known[alive]] = states
        states = after[places]
        at = np.flatnonzero(states >= 0)
        states = states[at]
        for k in range(1, self.words):
            inside = at + k < len(places)
            at, states = at[inside], states[inside]
            number = of_place[places[at + k]]
            inside = number >= 0
            at, states = at[inside], states[inside]
            states, alive = self.step(states, number[inside])
            at = at[alive]
        return at, states

    def phrases(self, states: np.ndarray) -> np.ndarray:
        """Word codes of accepting states, read back through check."""
        out = np.zeros((len(states), self.words), np.int64)
        s = states.astype(np.int64)
        for k in range(self.words - 1, -1, -1):
            for shift in range(0, DIGIT * self.digits, DIGIT):
                up = self.check[s].astype(np.int64)
                out[:, k] |= (s - self.base[up]) << shift
                s = up
        return self.symbols[out]


def _tries(candidates: DataFrame, k: int, shards: int) -> DataFrame:
    """(shard, symbols, base, check, digits, langs, lang_of): a trie for each shard of about SHARD candidates, chosen by a hash of the phrase."""
    names = [f"c{j}" for j in range(1, k + 1)]
    keyed = candidates.select(F.pmod(F.xxhash64(*names), F.lit(shards)).cast("int").alias("shard"), "lang", *names)

    def build(table: pa.Table) -> pa.Table:
        codes = np.stack([table[c].to_numpy().view(np.uint64) for c in names], axis=1)
        t = Trie(codes)
        langs = table["lang"].combine_chunks().dictionary_encode()
        lang_of = np.zeros(len(t.symbols), np.int32)
        lang_of[np.searchsorted(t.symbols, codes)] = langs.indices.to_numpy(zero_copy_only=False)[:, None]
        arrays = {n: [x.tobytes()] for n, x in (("symbols", t.symbols), ("base", t.base), ("check", t.check))}
        return pa.table({"shard": table["shard"][:1], **arrays, "digits": pa.array([t.digits], pa.int32()), "langs": [langs.dictionary.to_pylist()], "lang_of": [lang_of.tobytes()]})

    return keyed.groupBy("shard").applyInArrow(build, "shard int, symbols binary, base binary, check binary, digits int, langs array<string>, lang_of binary")


@lru_cache(maxsize=1)
def _load(name: str, k: int) -> tuple[Trie, list[str], np.ndarray]:
    """The trie in a file that was added to the session, its languages, and the language of each of its words."""
    table = pq.read_table(SparkFiles.get(name))
    row = {c: table[c].chunk(0)[0] for c in table.column_names}
    t = Trie.__new__(Trie)
    t.words, t.digits = k, row["digits"].as_py()
    t.symbols = np.frombuffer(row["symbols"].as_buffer(), np.uint64)
    t.base, t.check = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("base", "check"))
    return t, row["langs"].as_py(), np.frombuffer(row["lang_of"].as_buffer(), np.int32)


def _summed(states: np.ndarray, nexts: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (state, next) in order, and their counts or the sums of n."""
    order = np.lexsort((nexts, states))
    states, nexts = states[order], nexts[order]
    starts = np.flatnonzero(np.r_[True, (states[1:] != states[:-1]) | (nexts[1:] != nexts[:-1])])
    sums = np.diff(np.r_[starts, len(states)]) if n is None else np.add.reduceat(n[order], starts)
    return states[starts], nexts[starts], sums


def _packed(states: np.ndarray, nexts: np.ndarray, n: np.ndarray, deals: int) -> pa.RecordBatch:
    """(deal, states, nexts, n): rows of arrays, dealt by a hash of state and next, in the narrowest type that holds them."""
    mixed = states.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ nexts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    deal = ((mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(deals)
    order = np.argsort(deal, kind="stable")
    deal, states, nexts, n = deal[order], states[order], nexts[order], n[order]
    cuts = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
    wide = np.min_scalar_type(int(n.max()))
    parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(deal)]))
    columns = [[x[i:j].tobytes() for i, j in parts] for x in (states.astype(np.int32), nexts, n.astype(wide))]
    return pa.RecordBatch.from_arrays([pa.array(deal[cuts].astype(np.int32)), *[pa.array(x, pa.binary()) for x in columns]], names=["deal", "states", "nexts", "n"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    states, nexts, n = [], [], []
    for s, x, c in zip(*(table[name].to_pylist() for name in ("states", "nexts", "n"))):
        states.append(np.frombuffer(s, np.int32))
        m = len(states[-1])
        nexts.append(np.frombuffer(x, f"u{len(x) // m}").astype(np.uint64))
        n.append(np.frombuffer(c, f"u{len(c) // m}").astype(np.int64))
    return np.concatenate(states), np.concatenate(nexts), np.concatenate(n)


def _counted(blocks: DataFrame, file: str, k: int, longer: bool, alone: bool, least: int, deals: int) -> DataFrame:
    """(size, lang, c1 .., n): the phrases of the trie in file, and phrases of one word more, that occur least times or more.

    Tasks pass on arrays of states with their counts, and of states with a word behind them (its number in this trie
    where that is the only one of its length, so that both parts are known; its code otherwise). They are dealt out by
    a hash, so no group grows with one phrase, and summed.
    """
    names = [f"c{j}" for j in range(1, k + 2)]
    blocks.sparkSession.sparkContext.addFile(file)
    added = file.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, *_ = _load(added, k)
        total = np.zeros(len(trie.base), np.int64)
        seen: list[np.ndarray] = []
        nexts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = gathered = 0
        for b in batches:
            for codes, places in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("codes", "places"))):
                codes = np.frombuffer(codes, np.uint64)
                places = np.frombuffer(places, np.uint16 if len(codes) <= 1 << 16 else np.uint32)
                numbers = trie.numbers(codes)
                at, states = trie.accepted(numbers, places)
                seen.append(states)
                waiting += len(states)
                if waiting > len(total):
                    total += np.bincount(np.concatenate(seen), minlength=len(total))
                    seen, waiting = [], 0
                if not longer:
                    continue
                inside = at + k < len(places)
                if alone:
                    starts = np.zeros(len(places) + 1, bool)
                    starts[at] = True
                    good = inside & starts[np.minimum(at + 1, len(places))]
                    after = (numbers[places[at[good] + k]] + 1).astype(np.uint32)
                else:
                    good = inside
                    good[inside] = codes[places[at[inside] + k]] != 0
                    after = codes[places[at[good] + k]]
                nexts.append((states[good], after))
                gathered += len(after)
                if gathered > GATHER:
                    yield _packed(*_summed(*(np.concatenate(x) for x in zip(*nexts))), deals)
                    nexts, gathered = [], 0
        if gathered:
            yield _packed(*_summed(*(np.concatenate(x) for x in zip(*nexts))), deals)
        if seen:
            total += np.bincount(np.concatenate(seen), minlength=len(total))
        hit = np.flatnonzero(total)
        if len(hit):
            yield _packed(hit, np.zeros(len(hit), np.uint32), total[hit], deals)

    def add(table: pa.Table) -> pa.Table:
        states, after, n = _summed(*_unpacked(table))
        often = n >= least
        states, after, n = states[often], after[often], n[often]
        trie, langs, lang_of = _load(added, k)
        own = after == 0
        last = np.where(own, np.uint64(0), trie.symbols[(np.maximum(after, np.uint64(1)) - np.uint64(1)).astype(np.int64)] if alone else after)
        codes = trie.phrases(states)
        of = lang_of[np.searchsorted(trie.symbols, codes[:, 0])]
        langs = pa.DictionaryArray.from_arrays(pa.array(of), pa.array(langs, pa.string())).cast(pa.string())
        columns = {c: pa.array(np.ascontiguousarray(codes[:, j]).view(np.int64)) for j, c in enumerate(names[:-1])}
        return pa.table({"size": pa.array(np.where(own, k, k + 1).astype(np.int32)), "lang": langs, **columns, names[-1]: pa.array(last.view(np.int64), mask=own), "n": pa.array(n)})

    dealt = blocks.mapInArrow(run, "deal int, states binary, nexts binary, n binary")
    return dealt.groupBy("deal").applyInArrow(add, f"size int, lang string, {', '.join(f'{c} long' for c in names)}, n long")


def frequent_phrases(blocks: DataFrame, words: DataFrame, least: int, most_words: int, total: int) -> DataFrame:
    """(lang, key, f) of all words and phrases that occur least times or more; key is the array of their word codes, total the number of all words."""
    candidates = words.select("lang", F.col("code").alias("c1"))
    found = words.select("lang", F.array("code").alias("key"), F.col("n").alias("f"))
    deals = max(DEALS, total // GATHER)
    for k in range(1, most_words + 1):
        shards = -(-candidates.count() // SHARD)
        if not shards:
            break
        spark = blocks.sparkSession
        path = shared_dir(spark, "tries")
        _tries(candidates, k, shards).write.option("maxRecordsPerFile", 1).parquet(path)
        files = spark.read.parquet(path).select("shard", F.col("_metadata.file_path").alias("file")).collect()
        passes = [cut(_counted(blocks, unquote(r.file), k, k < most_words, shards == 1, least, deals)) for r in sorted(files)]
        counts = passes[0]
        for p in passes[1:]:
            counts = counts.unionByName(p)
        if k > 1:
            found = found.unionByName(counts.filter(F.col("size") == k).select("lang", F.array(*(f"c{j}" for j in range(1, k + 1))).alias("key"), F.col("n").alias("f")))
        candidates = counts.filter(F.col("size") == k + 1).select("lang", *(f"c{j}" for j in range(1, k + 2)))
    return found


def score_phrases(frequent: DataFrame, share: int) -> DataFrame:
    """(lang, key, a, l, r, score) of the phrases of two words or more that no longer one holds in share % of their places.

    The score is floor(2000000 a / (l + r)) at the cut where it is lowest; of equal ones the cut after fewest words counts.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    many = frequent.filter(F.size("key") > 1)
    inner = many.filter(F.size("key") > 2).select(
        "f",
        F.explode(F.expr("flatten(transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), i -> slice(key, i, m))))")).alias("key"),
    )
    both = many.select("lang", "key", F.col("f").alias("a"), F.lit(None).cast("long").alias("held")).unionByName(inner.select(F.lit(None).cast("string").alias("lang"), "key", F.lit(None).cast("long").alias("a"), F.col("f").alias("held")))
    kept = both.groupBy("key").agg(F.max("lang").alias("lang"), F.max("a").alias("a"), F.max("held").alias("held"))
    kept = kept.filter(F.col("held").isNull() | (F.lit(100).cast("decimal(5,0)") * wide("held") < F.lit(share).cast("decimal(5,0)") * wide("a")))
    cuts = kept.select("lang", "key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("slice(key, 1, k)")).withColumn("tail", F.expr("slice(key, k + 1, size(key) - k)"))
    counts = frequent.select(F.col("key").alias("part"), "f")
    cuts = shuffled(cuts, counts.withColumnRenamed("part", "head").withColumnRenamed("f", "l"), "head")
    cuts = shuffled(cuts, counts.withColumnRenamed("part", "tail").withColumnRenamed("f", "r"), "tail")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "key", "a").agg(best.alias("best")).select("lang", "key", "a", "best.l", "best.r", "best.score")


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds phrase, the words of key joined by a space; meant for the few phrases that are returned."""
    one = phrases.select("key", F.posexplode("key").alias("at", "code")).join(words.select("code", "word"), "code")
    spelled = one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    return phrases.join(spelled, "key").withColumn("phrase", F.array_join(F.col("spelled.word"), " "))


def collocations(docs: DataFrame, least: int = 30, most_words: int = 4, share: int = 80, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to most_words words, best first.

    A-Z are lower-cased, pieces end at . , ; : ! ? and line breaks, words at spaces and tabs. a counts a phrase's
    occurrences, l and r those of its two parts, n all words of the language. Phrases with fewer than `least`
    occurrences, or held by a longer one in `share` % of them, are left out. rank orders by score and a, both
    descending, then by the phrase's bytes; top None returns all. A null text counts as empty, a null language as `und`;
    repeated rows count each time; other columns are not read. An empty table gives no rows. A document's words are
    worked on by one task; nothing else grows with one row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    small_bytes(spark, BYTES)
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    path = shared_dir(spark, "words")
    _word_counts(given).write.parquet(path)
    words, salt = _coded(spark.read.parquet(path))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    path = shared_dir(spark, "blocks")
    _blocks(given, salt).write.parquet(path)
    words = cut(words.filter(F.col("n") >= least))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = frequent_phrases(spark.read.parquet(path), words, least, most_words, total)
    scored = cut(score_phrases(frequent, share))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    if top is not None:  # phrases are spelled after this: equals of the last rank stay in until then
        scored = scored.withColumn("place", F.expr("rank() over (partition by lang order by score desc, a desc)")).filter(F.col("place") <= top).drop("place")
    ranked = _spelled(scored, words).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

