"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes with separate control bytes.

A block holds whole documents in order. Each id is replaced by its frequency rank, and a rank takes
as few bytes as it needs; its length less one is two bits of the control bytes, four ranks to a byte.
A reader turns all control bytes into lengths by one table lookup and gathers the data bytes at their
running offsets, without a loop over values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, parts, shared_dir, small_batches

#: Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    widest = int(size.max(initial=1))
    raw = v.astype("<u2").view(np.uint8).reshape(-1, 2) if widest <= 2 else v.view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(raw.shape[1]) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        out |= (raw[at + k] * (size > k)).astype(np.uint32) << np.uint32(8 * k)
    return out


class WordEncoder:
    """Ids of whole texts from a word-splitting BPE file, with a bounded cache of their words' pieces.

    The file's splitter never joins what white space parts, and its merges never cross a piece, so a
    text's ids are its words' ids in order. Texts with characters outside the plain ranges below,
    where normalisation or character classes could differ from the library's, and texts with a
    special token's string go to the library whole.
    """

    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    UNUSUAL = "[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏЀ-҂Ҋ-ӿ‐-‧€ぁ-ゖァ-ヺ一-龥]"

    def __init__(self, path: str, cache_pieces: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # the same vocabulary and merges for pieces that are split and normalised already
        rules = json.loads(self.library.to_str())
        rules["normalizer"] = None
        rules["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.plain = Tokenizer.from_str(json.dumps(rules))
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([self.UNUSUAL, *map(re.escape, special)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = cache_pieces

    def _learn(self, pieces: set[str]) -> None:
        """Ids of new pieces, many in one call; each ends with the one token that carries the word end."""
        if len(self.known) > self.most:  # what comes again moves over, the rest is forgotten next time
            self.older, self.known = self.known, {}
        new = pieces - self.known.keys()
        again = new & self.older.keys()
        self.known.update((p, self.older[p]) for p in again)
        new = sorted(new - again)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer's pieces don't end with one word end each")
            step, raw = self.kind.itemsize, ids.tobytes()
            self.known.update((p, raw[a * step : b * step]) for p, a, b in zip(part, [0, *stops[:-1].tolist()], stops.tolist()))

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """A word of letters is one piece, one with a mark behind it two; the others are put together from theirs."""
        plain, marks, find = str.isalpha, ".,;:!?", self.PIECE.findall
        split = [w if plain(w) else (w[:-1], w[-1]) if w[-1:] in marks and plain(w[:-1]) else find(w) for w in words]
        pieces = {s for s in split if isinstance(s, str)}
        pieces.update(p for s in split if not isinstance(s, str) for p in s)
        self._learn(pieces)
        known = self.known
        return [known[s] if isinstance(s, str) else b"".join([known[p] for p in s]) for s in split]

    def encode(self, batch: pa.Array, end_id: int) -> tuple[np.ndarray, pa.Array]:
        """Number of ids of each text with end_id behind them, and the ids as little-endian bytes of self.kind.

        Words are coded by Arrow; Python sees each different word of a batch once.
        """
        batch = pc.fill_null(batch, "")
        odd = pc.match_substring_regex(batch, self.odd)
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", batch)))
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        raw = self.ids_of_words(different) + [np.array([end_id], self.kind).tobytes()]
        step = self.kind.itemsize
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // step
        start = np.cumsum(size) - size
        stops = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        which = np.insert(coded.indices.to_numpy(zero_copy_only=False), stops, len(different))
        n = size[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(raw), self.kind)[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends[stops + np.arange(len(stops))]))
        if pc.any(odd).as_py():
            own = [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                own[i] = np.array([*self.library.encode(batch[i].as_py(), add_special_tokens=False).ids, end_id], self.kind)
            ids, bounds = np.concatenate(own), np.cumsum([0, *map(len, own)])
        offsets = pa.py_buffer((bounds * step).astype(np.int32).tobytes())
        return np.diff(bounds), pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(ids.tobytes())])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _together(batches: Iterator[pa.RecordBatch], least_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about least_bytes, so that a word's ids are looked up less often."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= least_bytes:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text and end_id, two bytes an id where the vocabulary fits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in _together(batches):
            n, ids = enc.encode(part.column(1), end_id)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), ids], names=["doc_id", "n_tokens", "ids"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _counts(kind: np.dtype, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # a worker that tokenized before gives its cache's memory back
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return run


def _blocks(kind: np.dtype, rank_of: np.ndarray, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            control, data = encode_values(rank_of[np.frombuffer(b"".join(ids), kind)])
            row = {"part": part, "block": number, "start": start, "n_tokens": held, "doc_ids": docs[:], "lengths": lengths[:], "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for b in batches:
            for d, n, x in zip(*(c.to_pylist() for c in b.columns)):
                docs.append(d)
                lengths.append(n)
                ids.append(x)
                held += n
                if held >= block_tokens:
                    yield block()
                    number, start, held = number + 1, start + held, 0
                    docs.clear(), lengths.clear(), ids.clear()
        if docs:
            yield block()

    return run


SCHEMA = pa.schema(
    [("part", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)
DDL = "part long, block long, start long, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_tokens: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize documents and write them to path in ascending id order (null ids last).

    path/ids holds the ids as the tokenizer gave them, path/ranks the ranking (id, rank; as many
    rows as the vocabulary at most), path/blocks the encoded blocks, one file for each range of
    ids. Documents with equal ids follow each other in the order of their ids' hash and bytes, so
    one id with very many rows is still dealt over several ranges. A null or empty text is end_id alone.
    """
    spark = docs.sparkSession
    tokenize(docs, tokenizer, end_id, id_col, text_col).write.parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    enc = encoder(tokenizer)
    kind, size = enc.kind, enc.size
    ranked = ids.select("ids").mapInArrow(_counts(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r.id for r in ranked.orderBy(F.desc("n"), "id").collect()]  # at most the vocabulary
    spark.createDataFrame([(i, k) for k, i in enumerate(order)], "id int, rank int").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    small_batches(spark)
    keyed = ids.withColumn("tie", F.xxhash64("ids"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = keyed.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys, "ids").select("doc_id", "n_tokens", "ids")
    dealt.mapInArrow(_blocks(kind, rank_of, block_tokens), DDL).write.parquet(f"{path}/blocks")


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r.id for r in ranks], "<u4")
    # one row for each file: the ids in all files before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = id_of[decode_values(row["control"], row["data"], row["n_tokens"])]
                n = np.array(row["lengths"], np.int64)
                at = np.cumsum(n) - n
                raw = [ids[a : a + k].tobytes() for a, k in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(at + row["start"] + row["base"]), pa.array(n), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    return blocks.join(base, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write documents as token files and return what reading them back gives, one row per document.

    An empty table gives empty files and an empty result; repeated rows stay; other columns are not read.
    """
    path = path or shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col)
    return read_token_files(docs.sparkSession, path)
