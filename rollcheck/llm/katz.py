"""Katz backoff scores of texts under a word bigram model trained on a part of them.

Words get ids in the order of their counts, so an id alone tells a word's count. Pairs of ids are
dealt by their history over buckets, the partitions of the bigram table; a bucket counts its pairs,
knows each history's discounted mass and backoff weight, and scores the tokens that documents ask
for. A token is scored by its pair if training has it, and otherwise by the history's backoff
weight and the word's own discounted probability. Histories too frequent for one bucket are dealt
by the whole pair; their masses are added up over buckets before their backoff weights are used.
Only numpy arrays travel, packed and compressed, a row for each block of documents and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, small_batches

#: Ids that are no word's: a word that training lacks, and the history of a text's first token.
UNKNOWN, START = (1 << 32) - 1, (1 << 32) - 2
#: The end token; no word holds a line feed.
END = b"\n"


def discounts(of_counts: dict[int, float], k: int = 5) -> np.ndarray:
    """Good-Turing factors for counts 1 .. k (index 0 unused), after Katz; the largest k whose factors all lie in (0, 1).

    Without any such k no count is discounted.
    """
    n = lambda r: float(of_counts.get(r, 0))
    for top in range(k, 0, -1):
        if not n(1) or any(not n(r) for r in range(1, top + 2)):
            continue
        common = (top + 1) * n(top + 1) / n(1)
        if common >= 1:
            continue
        d = [((r + 1) * n(r + 1) / n(r) / r - common) / (1 - common) for r in range(1, top + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d])
    return np.ones(1)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    small = np.minimum(counts, len(d) - 1)
    return counts * np.where(counts < len(d), d[small], 1.0)


class Unigrams:
    """Probabilities by count: known words discounted, the rest for the one unknown word."""

    def __init__(self, of_counts: dict[int, int]) -> None:
        self.counts = np.array(sorted(of_counts, reverse=True), np.int64)
        types = np.array([of_counts[c] for c in self.counts.tolist()], np.int64)
        self.starts = np.cumsum(types) - types  # first id of each count, the largest count first
        self.n_types, self.n_tokens = int(types.sum()), int((self.counts * types).sum())
        d = discounts(of_counts)
        p = discounted(self.counts, d) / max(1, self.n_tokens)
        self.p_unknown = 1 - float((p * types).sum())
        if self.p_unknown < 1e-12:
            p = self.counts / (self.n_tokens + 1)
            self.p_unknown = 1 / (self.n_tokens + 1)
        self.p = p

    def _row(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, side="right") - 1

    def count(self, ids: np.ndarray) -> np.ndarray:
        known = ids < self.n_types
        return np.where(known, self.counts[self._row(np.where(known, ids, 0))], 0) if self.n_types else np.zeros(len(ids), np.int64)

    def prob(self, ids: np.ndarray) -> np.ndarray:
        known = ids < self.n_types
        return np.where(known, self.p[self._row(np.where(known, ids, 0))], self.p_unknown) if self.n_types else np.full(len(ids), self.p_unknown)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: kinds and lengths, then each array's bytes by significance."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(np.array([a.dtype.itemsize, ord(a.dtype.kind), len(a)], np.int64).tobytes() + a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        size, kind, n = np.frombuffer(raw, np.int64, 3, at).tolist()
        planes = np.frombuffer(raw, np.uint8, size * n, at + 24).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(f"{chr(kind)}{size}")) if n else np.zeros(0, np.dtype(f"{chr(kind)}{size}")))
        at += 24 + size * n
    return out


class Block:
    """Some documents' tokens by local number; words' hashes in ascending order of hash."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        number: dict[bytes, int] = {END: 0}
        tokens, lengths, self.ids, train = [], [], [], []
        for b in batches:
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column(1), "")))
            flat = split.flatten()
            real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
            n = np.diff(np.concatenate(([0], np.cumsum(real)))[bounds])
            coded = flat.cast(pa.binary()).dictionary_encode()
            words = np.array([number.setdefault(w, len(number)) if w else 0 for w in coded.dictionary.to_pylist()], np.int64)
            own = words[coded.indices.to_numpy(zero_copy_only=False)[real]] if len(words) else np.zeros(0, np.int64)
            tokens.append(np.insert(own, np.cumsum(n), 0))
            lengths.append(n + 1)
            self.ids += b.column(0).to_pylist()
            train.append(b.column(2).to_numpy(zero_copy_only=False))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.lengths, self.train = np.concatenate(lengths), np.concatenate(train).astype(bool)
        self.tokens = place[np.concatenate(tokens)]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.mark = xxhash.xxh32_intdigest(self.hashes.tobytes())

    def counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train[self.doc]], minlength=len(self.hashes))


def _read_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, Block]]:
    """Blocks of about block_bytes of text, numbered by partition and place in it."""
    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= block_bytes:
            yield (part << 32) + k, Block(held)
            k, held, size = k + 1, [], 0
    if held:
        yield (part << 32) + k, Block(held)


def _word_requests(log_buckets: int, block_bytes: int):
    """A row for each block and bucket of words: the words' hashes and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _read_blocks(batches, block_bytes):
            counts = block.counts()
            bucket = (block.hashes >> np.uint64(64 - log_buckets)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << log_buckets) + 1))
            rows = [(b, number, block.mark, pack(block.hashes[x:y], counts[x:y].astype(np.uint32))) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["bucket", "block", "mark", "words"])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """A bucket's words with their counts, those that training has, and how many have each count."""
    found = [unpack(x) for x in table.column("words").to_pylist()]
    hashes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([f[1] for f in found]), len(hashes)).astype(np.int64)
    hashes, counts = hashes[counts > 0], counts[counts > 0]
    c, n = np.unique(counts, return_counts=True)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "counted": pa.array([pack(hashes, counts)], pa.binary()), "c": pa.array([c], pa.list_(pa.int64())), "n": pa.array([n], pa.list_(pa.int64()))})


def _answer_words(requests: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of the words that each block asked for."""
    hashes, counts = unpack(words.column("counted")[0].as_py())
    bases = {x["c"]: x["base"] for x in words.column("bases")[0].as_py() or []}
    ids = np.zeros(len(counts), np.int64)
    order = np.argsort(counts, kind="stable")
    c, first, n = np.unique(counts[order], return_index=True, return_counts=True)
    for x, f, k in zip(c.tolist(), first.tolist(), n.tolist()):
        ids[order[f : f + k]] = bases[x] + np.arange(k)
    out = []
    for x in requests.column("words").to_pylist():
        asked = unpack(x)[0]
        at = np.minimum(np.searchsorted(hashes, asked), max(0, len(hashes) - 1))
        out.append(pack(np.where(hashes[at] == asked, ids[at], UNKNOWN).astype(np.uint32) if len(hashes) else np.full(len(asked), UNKNOWN, np.uint32)))
    return requests.select(["block", "mark", "bucket"]).append_column("ids", pa.array(out, pa.binary()))


def _carried(block_bytes: int):
    """A row for each block: its tokens, to meet the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _read_blocks(batches, block_bytes):
            body = pack(b.tokens.astype(np.uint32), b.lengths.astype(np.uint32), b.train.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b.mark], pa.int64()), pa.array([len(b.hashes)], pa.int64()), pa.array([b.ids], pa.list_(pa.int64())), pa.array([body], pa.binary())], names=["block", "mark", "n_words", "doc_ids", "body"])

    return run


PAIRS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary())])


def _ask_pairs(words: Unigrams, n_hot: int, n_buckets: int):
    """A block's header (per-document sums that need no pair) and its pairs for each bucket."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise ValueError("the documents changed their order between two reads; checkpoint them first")
        rows = sorted(zip(answers.column("mark").to_pylist(), answers.column("bucket").to_pylist(), answers.column("ids").to_pylist()))
        ids = np.concatenate([unpack(x)[0] for _, _, x in rows])
        mark, n_words = block.column("mark")[0].as_py(), block.column("n_words")[0].as_py()
        if len(ids) != n_words or any(m != mark for m, _, _ in rows):
            raise ValueError("the documents changed their order between two reads; checkpoint them first")
        tokens, lengths, train = unpack(block.column("body")[0].as_py())
        word = ids[tokens]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        counts = words.count(word)
        base = np.bincount(doc, np.log10((counts + 1) / (words.n_tokens + words.n_types + 1)), len(lengths))
        known = np.bincount(doc, counts > 0, len(lengths)).astype(np.int64)
        history = np.empty(len(word), np.uint32)
        history[1:] = word[:-1]
        history[np.cumsum(lengths.astype(np.int64)) - lengths] = START
        alone = history == UNKNOWN  # no history in training: the word's own probability
        direct = np.bincount(doc[alone], np.log10(words.prob(word[alone])), len(lengths)).astype(float)  # of no weights it makes integers
        number = block.column("block")[0].as_py()
        out = [(number % n_buckets, number, block.column("doc_ids")[0].as_py(), pack(lengths.astype(np.int64), known, base, direct))]

        key = (history[~alone].astype(np.uint64) << np.uint64(32)) | word[~alone]
        d = doc[~alone].astype(np.uint32)
        order = np.lexsort((d, key))
        key, d = key[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (d[1:] != d[:-1])))) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key))).astype(np.uint32)
        key, d = key[first], d[first]
        bucket = _bucket(key, n_hot, n_buckets)
        order = np.argsort(bucket, kind="stable")
        key, d, times, bucket = key[order], d[order], times[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if y > x:
                step = np.diff(key[x:y], prepend=np.uint64(0))
                out.append((b, number, None, pack(step, d[x:y], times[x:y], train[d[x:y]])))
        cols = list(zip(*out))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PAIRS)], schema=PAIRS)

    return run


def _bucket(key: np.ndarray, n_hot: int, n_buckets: int) -> np.ndarray:
    """By the history, or by the whole pair for the n_hot most frequent words and for a text's start."""
    h = key >> np.uint64(32)
    hot = (h < n_hot) | (h == START)
    mixed = np.where(hot, key, h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)


class _Pairs:
    """A bucket's pairs with their training counts, and who asks for them."""

    def __init__(self, table: pa.Table) -> None:
        body, number = table.column("body").to_pylist(), table.column("block").to_pylist()
        header = [x is not None for x in table.column("doc_ids").to_pylist()]
        found = [(n, unpack(b)) for n, b, h in zip(number, body, header) if not h]
        self.blocks = [n for n, _ in found]
        join = lambda k, kind: np.concatenate([f[k] for _, f in found]) if found else np.zeros(0, kind)
        keys = np.concatenate([np.cumsum(f[0]) for _, f in found]) if found else np.zeros(0, np.uint64)
        self.doc, self.times, train = join(1, np.uint32), join(2, np.uint32), join(3, np.uint8)
        self.row = np.repeat(np.arange(len(found)), [len(f[0]) for _, f in found]) if found else np.zeros(0, np.int64)
        self.key, self.at = np.unique(keys, return_inverse=True)
        self.count = np.bincount(self.at, self.times * train, len(self.key)).astype(np.int64)


def _pair_counts(table: pa.Table) -> pa.Table:
    """How many of a bucket's pairs have each small count."""
    c = _Pairs(table).count
    n = np.bincount(c[(c > 0) & (c < 10)], minlength=10)[1:]
    return pa.table({"c": pa.array(np.arange(1, 10)), "n": pa.array(n.astype(np.int64))})


SCORES = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary())])


def _score_pairs(words: Unigrams, n_hot: int, n_train: int):
    def run(table: pa.Table, small: pa.Table) -> pa.Table:
        out = [("header", *r) for r in zip(*(table.column(c).to_pylist() for c in ("block", "doc_ids", "body"))) if r[1] is not None]
        p = _Pairs(table)
        if len(p.key):
            d = discounts({x["c"]: x["n"] for x in small.column("small")[0].as_py() or []})
            h, w = p.key >> np.uint64(32), p.key & np.uint64(0xFFFFFFFF)
            total = np.where(h == START, n_train, words.count(h.astype(np.int64)))
            seen = p.count > 0
            prob = np.where(seen, discounted(p.count, d) / np.maximum(total, 1), 0.0)
            low = words.prob(w.astype(np.int64))
            group, at = np.unique(h, return_inverse=True)
            mass, under = np.bincount(at, prob, len(group)), np.bincount(at, low * seen, len(group))
            hot = (group < n_hot) | (group == START)
            bare = (1 - mass < 1e-9) & ~hot  # nothing is discounted: one count more in the denominator
            size = np.zeros(len(group))
            size[at] = total
            mass = np.where(bare, size / (size + 1), mass)
            prob = np.where(bare[at] & seen, prob * (size / (size + 1))[at], prob)
            weight = (1 - mass) / (1 - under)
            late = hot[at]
            with np.errstate(divide="ignore"):
                value = np.where(seen, np.log10(prob), np.log10(low) + np.where(late, 0.0, np.log10(np.maximum(weight, 1e-300))[at]))
            spot = p.row * (int(p.doc.max()) + 1) + p.doc
            who, where = np.unique(spot, return_inverse=True)
            score = np.bincount(where, value[p.at] * p.times, len(who))
            row, doc = who // (int(p.doc.max()) + 1), who % (int(p.doc.max()) + 1)
            ask = np.flatnonzero(late[p.at])
            asked = np.stack((p.row[ask], p.doc[ask], at[p.at[ask]]))
            keys, back = np.unique(asked, axis=1, return_inverse=True) if len(ask) else (asked, np.zeros(0, np.int64))
            back = back.reshape(-1)
            new = np.bincount(back, p.times[ask] * ~seen[p.at[ask]], keys.shape[1])
            old = np.bincount(back, p.times[ask] * seen[p.at[ask]], keys.shape[1])
            for k, number in enumerate(p.blocks):
                m, z = row == k, keys[0] == k
                out.append(("part", number, None, pack(doc[m].astype(np.uint32), score[m], keys[1][z].astype(np.uint32), group[keys[2][z]].astype(np.uint32), new[z].astype(np.uint32), old[z].astype(np.uint32))))
            out.append(("mass", 0, None, pack(group[hot].astype(np.uint32), mass[hot], under[hot])))
        cols = list(zip(*out)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, SCORES)], schema=SCORES)

    return run


def _finish(words: Unigrams, n_train: int, masses: dict[int, tuple[float, float]]):
    """Adds up a block's parts, with the backoff weights of the frequent histories."""
    ids = np.array(sorted(masses), np.int64)
    mass, under = (np.array([masses[i][k] for i in ids.tolist()]) for k in (0, 1))
    size = np.where(ids == START, n_train, words.count(ids)).astype(float)
    bare = 1 - mass < 1e-9
    again = np.where(bare, np.log10(size / (size + 1)), 0.0)  # for pairs that training has
    back = np.log10(np.where(bare, 1 / (size + 1), 1 - mass) / (1 - under))

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        body = table.column("body").to_pylist()
        top = kinds.index("header")
        lengths, known, base, score = unpack(body[top])
        score = score.copy()
        for kind, b in zip(kinds, body):
            if kind == "part":
                doc, value, late, history, new, old = unpack(b)
                score += np.bincount(doc, value, len(score))
                if len(late):
                    at = np.searchsorted(ids, history)
                    score += np.bincount(late, new * back[at] + old * again[at], len(score))
        n = len(lengths)
        return pa.table({"doc_id": pa.array(table.column("doc_ids")[top].as_py(), pa.int64()), "n_tokens": lengths, "n_known": known, "train_tokens": np.full(n, words.n_tokens), "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, train: Column, block_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    train chooses the rows to learn from. Words are runs without ASCII white space, A-Z in lower
    case; a text ends with one more token. A null or empty text is that token alone. Words that
    training lacks share the probability of one unknown word. With no training rows, all tokens are
    unknown and score 0. Repeated rows and ids stay. The documents are read twice and must come in
    one order, as from files; otherwise a task fails and says so.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    log_buckets, n_buckets = max(4, (parts(spark) - 1).bit_length()), 2 * parts(spark)
    requests = rows.mapInArrow(_word_requests(log_buckets, block_bytes), "bucket int, block long, mark long, words binary")
    counted = cut(requests.groupBy("bucket").applyInArrow(_count_words, "bucket int, counted binary, c array<long>, n array<long>"))
    each = counted.select("bucket", F.explode(F.arrays_zip("c", "n")).alias("x")).select("bucket", "x.c", "x.n")
    of_counts = {r.c: r.n for r in each.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # one row for each different count
    words = Unigrams(of_counts)
    n_train = int(rows.agg(F.count_if("train")).first()[0])
    starts = spark.createDataFrame(list(zip(words.counts.tolist(), words.starts.tolist())), "c long, start long")
    before = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "c")
    bases = based.groupBy("bucket").agg(F.collect_list(F.struct("c", (F.col("start") + F.col("before")).alias("base"))).alias("bases"))
    named = counted.select("bucket", "counted").join(bases, "bucket", "left")
    answers = requests.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(_answer_words, "block long, mark long, bucket int, ids binary")

    # words more frequent than a quarter of a bucket; at most 4 x n_buckets
    limit = max(1, words.n_tokens // (4 * n_buckets))
    n_hot = int(sum(n for c, n in of_counts.items() if c > limit))
    carried = rows.mapInArrow(_carried(block_bytes), "block long, mark long, n_words long, doc_ids array<long>, body binary")
    pairs = carried.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_pairs(words, n_hot, n_buckets), "bucket int, block long, doc_ids array<long>, body binary")
    small = pairs.groupBy("bucket").applyInArrow(_pair_counts, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    small = small.agg(F.collect_list(F.struct("c", "n")).alias("small")).select(F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket"), "small")
    scored = pairs.groupBy("bucket").cogroup(small.groupBy("bucket")).applyInArrow(_score_pairs(words, n_hot, n_train), "kind string, block long, doc_ids array<long>, body binary")
    scored = cut(scored)
    masses: dict[int, tuple[float, float]] = {}
    for r in scored.filter("kind = 'mass'").select("body").toLocalIterator():  # a row a bucket, of at most n_hot + 1 histories
        for h, m, u in zip(*unpack(r.body)):
            a, b = masses.get(int(h), (0.0, 0.0))
            masses[int(h)] = (a + float(m), b + float(u))
    return scored.filter("kind <> 'mass'").groupBy("block").applyInArrow(_finish(words, n_train, masses), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
