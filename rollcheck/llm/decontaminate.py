"""Benchmark passages in documents: CGK embedding, bit-sampling hashing and exact edit distance on words.

The random-walk embedding reads a word sequence with one pointer and, at each step, repeats or moves
on by a random bit that depends on the step and the word alone; similar sequences fall back into
step, so edit distance becomes Hamming distance. Tables that sample a few positions of the embedded
windows find candidates; an exact edit distance against the item decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, small_batches, texts

#: ASCII in lower case, all but letters and digits as spaces; bytes of other letters stay.
PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() or i >= 128 else 32 for i in range(128)) + bytes(range(128, 256))
OTHER_MARKS = re.compile("[\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf×÷ -⁯₠-⃏←-⯿　-〿！-／：-＠]")
#: Items with fewer words are no evidence; up to EXACT_WORDS they count only without edits.
LEAST_WORDS, EXACT_WORDS = 3, 5
PROBE_WORDS = 64


def words(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits."""
    return OTHER_MARKS.sub(" ", text.lower()).encode().translate(PLAIN).split()


def allowed_edits(n: int, similarity: float) -> int:
    return 0 if n <= EXACT_WORDS else int((1 - similarity) * n + 1e-9)


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Index:
    """Probes of some items: a short item whole, a longer one in stretches of at most PROBE_WORDS words.

    At least one stretch of an item has no more than its share of the edits. A window within d edits
    of a probe of n words has at least n - 2 - 3 d of its word triples, which passes over all other
    windows without loss before they are embedded.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = 0.8, walks: int = 8, tables: int = 9, samples: int = 3, seed: int = 42) -> None:
        self.similarity, self.walks, self.tables, self.samples = similarity, walks, tables, samples
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            w = words(text or "")
            if len(w) >= LEAST_WORDS:
                self.items.append((item_id, np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64)))
        self.probes: dict[int, list[tuple[int, int]]] = {}  # length -> (item, offset)
        for k, (_, w) in enumerate(self.items):
            n = -(-len(w) // PROBE_WORDS)
            cuts = [len(w) * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.probes.setdefault(b - a, []).append((k, a))
        rng = np.random.default_rng(seed)
        self.triples, self.sampled, self.keys = {}, {}, {}
        every = [np.zeros(0, np.uint64)]
        for n, probes in self.probes.items():
            text = np.stack([self.items[k][1][a : a + n] for k, a in probes])
            self.triples[n] = np.unique(self.triple(text.reshape(-1))[: text.size].reshape(text.shape)[:, : n - 2])
            every.append(self.triples[n])
            self.sampled[n] = rng.integers(0, 2 * n, (walks, tables, samples))  # the walk leaves the window at about 2 n
            key = self.hashed(text, n).reshape(len(text), -1)
            probe = np.repeat(np.arange(len(text)), key.shape[1])
            order = np.argsort(key.reshape(-1), kind="stable")
            self.keys[n] = key.reshape(-1)[order], probe[order]
        self.all_triples = np.unique(np.concatenate(every))

    @staticmethod
    def triple(ids: np.ndarray) -> np.ndarray:
        """A number for the three words from each position; 0 where one is no item's word."""
        x = np.concatenate((ids, [0, 0])).astype(np.uint64)
        a, b, c = x[:-2], x[1:-1], x[2:]
        return np.where((a > 0) & (b > 0) & (c > 0), _hash(_hash(_hash(a) + b) + c) | np.uint64(1), np.uint64(0))

    def hashed(self, windows: np.ndarray, n: int) -> np.ndarray:
        """Keys (window, walk, table) of embedded windows of n words."""
        rows = len(windows)
        padded = np.concatenate((windows, np.zeros((rows, 1), np.int64)), axis=1)
        taken = self.sampled[n]
        value = np.zeros((rows, *taken.shape), np.uint64)
        for walk in range(self.walks):
            at = np.zeros(rows, np.int64)
            for step in range(2 * n):
                symbol = padded[np.arange(rows), at]
                for t, s in zip(*np.nonzero(taken[walk] == step)):
                    value[:, walk, t, s] = symbol
                bit = _hash(symbol.astype(np.uint64) + np.uint64((walk * 1009 + step + 1) << 40)) & np.uint64(1)
                at = np.minimum(at + bit.astype(np.int64), n)  # behind the window its end is repeated
        key = np.broadcast_to((np.arange(self.walks)[:, None] * self.tables + np.arange(self.tables) + 1).astype(np.uint64), value.shape[:3]).copy()
        for s in range(self.samples):
            key = _hash(key + value[..., s])
        return key

    def candidates(self, ids: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, item, expected start) from the joined word ids of documents with the given bounds."""
        triple = self.triple(ids)
        where = np.minimum(np.searchsorted(self.all_triples, triple), max(0, len(self.all_triples) - 1))
        hit = np.flatnonzero((self.all_triples[where] == triple) & (triple > 0)) if len(self.all_triples) else np.zeros(0, np.int64)
        doc = np.searchsorted(bounds, hit, side="right") - 1
        hit, doc = hit[hit + 3 <= bounds[doc + 1]], doc[hit + 3 <= bounds[doc + 1]]
        out: set[tuple[int, int, int]] = set()
        for n, probes in self.probes.items():
            need = n - 2 - 3 * allowed_edits(n, self.similarity)
            if need < 1:  # so many edits are allowed that no triple need be left: every window is embedded
                low = bounds[:-1][bounds[:-1] < bounds[1:]]
                high = bounds[1:][bounds[:-1] < bounds[1:]] - n
            else:
                own = np.isin(triple[hit], self.triples[n])
                p, d = hit[own], doc[own]
                if len(p) < need:
                    continue
                # stretches of `need` hits of one document within the window's triples
                k = np.flatnonzero((p[need - 1 :] - p[: len(p) - need + 1] <= n - 3) & (d[need - 1 :] == d[: len(d) - need + 1]))
                low = np.maximum(p[k + need - 1] - (n - 3), bounds[d[k]])
                high = np.minimum(p[k], bounds[d[k] + 1] - n)
            if not len(low):
                continue
            # a document that ends within the last window: the window that ends with it
            starts = np.unique(np.concatenate([np.arange(a, max(a, b) + 1) for a, b in zip(low.tolist(), high.tolist())]))
            whose = np.searchsorted(bounds, starts, side="right") - 1
            at = starts[:, None] + np.arange(n)
            windows = np.where(at < bounds[whose + 1][:, None], ids[np.minimum(at, len(ids) - 1)], 0)
            different, which = np.unique(windows, axis=0, return_inverse=True)
            which = which.reshape(-1)
            table, probe = self.keys[n]
            for part in range(0, len(different), 4096):
                key = self.hashed(different[part : part + 4096], n).reshape(-1)
                row = np.repeat(np.arange(part, min(part + 4096, len(different))), self.walks * self.tables)
                a, b = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
                met = np.flatnonzero(b > a)
                pairs = {(int(row[i]), int(x)) for i in met for x in probe[a[i] : b[i]]}
                by_window: dict[int, list[int]] = {}
                for r, x in pairs:
                    by_window.setdefault(r, []).append(x)
                for i in np.flatnonzero(np.isin(which, list(by_window))).tolist():
                    for x in by_window[int(which[i])]:
                        item, offset = probes[x]
                        out.add((int(whose[i]), item, int(starts[i]) - offset))
        return out

    def matches(self, batch: list[str]) -> list[tuple[int, int | None, int, int, int, float]]:
        """(row, item_id, start, end, edits, similarity): the best place of each matching item in each text, in words."""
        get = self.vocab.get
        split = [words(t) for t in batch]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))
        ids = np.fromiter((get(w, 0) for s in split for w in s), np.int64, int(bounds[-1]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        near: dict[tuple[int, int], list[int]] = {}
        for d, item, start in self.candidates(ids, bounds):
            near.setdefault((d, item), []).append(start)
        for (d, item), starts in near.items():
            w = self.items[item][1]
            most = allowed_edits(len(w), self.similarity)
            starts.sort()
            groups = [[starts[0], starts[0]]]
            for s in starts[1:]:
                if s - groups[-1][1] > len(w) + 2 * most:
                    groups.append([s, s])
                groups[-1][1] = s
            for a, b in groups:
                low = max(int(bounds[d]), a - 2 * most - 1)
                high = min(int(bounds[d + 1]), b + len(w) + 2 * most + 1)
                found = closest(w, ids[low:high])
                if found[0] <= most:
                    at = low - int(bounds[d])
                    best[d, item] = min(best.get((d, item), (1 << 30, 0, 0)), (found[0], at + found[1], at + found[2]))
        return [(d, self.items[k][0], a, z, e, 1 - e / len(self.items[k][1])) for (d, k), (e, a, z) in sorted(best.items())]


def _ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fewest edits that turn the item into some stretch of the text ending at each position."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, w in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        new[0] = k + 1
        row = np.minimum.accumulate(new - step) + step
    return row


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of the text nearest to the item; the first on ties, and the shortest there."""
    ends = _ends(item, text)
    end = int(ends.argmin())
    back = _ends(item[::-1], text[:end][::-1])
    start = end - int(back.argmin())
    return int(ends[end]), start, end


def _blocks(items: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of at most block_items items, each small enough to broadcast."""
    part: list[tuple[int | None, str]] = []
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    for r in rows.toLocalIterator():
        part.append((r.item_id, r.text))
        if len(part) >= block_items:
            yield part
            part = []
    if part:
        yield part


SCHEMA = "doc_id long, item_id long, start_word long, end_word long, edits long, similarity double"


def find_matches(docs: DataFrame, items: DataFrame, similarity: float = 0.8, block_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row and item it holds: doc_id, item_id, start_word, end_word, edits, similarity.

    An item is held where its words turn into a stretch of the document's by at most (1 - similarity)
    edits a word. Items under 3 words are never held, to 5 words only without edits. The benchmark is
    taken in blocks of block_items items against all documents, so each broadcast is bounded. Null
    and empty texts hold nothing; repeated rows and items give repeated results, one of them where an item's places
    tie. Long texts are looked through whole; where the similarity leaves an item no word triple, all windows are
    embedded. Other columns, whatever their names, are not read, and empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = ids_and_texts(docs, id_col, text_col)
    found = None
    for block in _blocks(items, item_id_col, item_text_col, block_items):
        sent = spark.sparkContext.broadcast(Index(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                got = [(ids[d], *rest) for d, *rest in sent.value.matches(texts(b))]
                cols = list(zip(*got)) if got else [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start_word", "end_word", "edits", "similarity"])

        part = rows.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, block_items: int = 20_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item; a pass over the documents for each block of items."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in _blocks(items, item_id_col, item_text_col, block_items):
        sent = spark.sparkContext.broadcast(Index(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[m[0] for m in sent.value.matches(texts(b, text_col))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
