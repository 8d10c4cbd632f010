"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

A covering family for radius r gives every bit position a non-zero vector of r + 1 bits and has one
table for each non-zero vector v: the table keeps the bits whose vector has an odd product with v.
The vectors of at most r differing bits never span the whole space, so some v is orthogonal to all
of them; that table keeps none of the differing bits and the two fingerprints meet in it. Nothing
within the radius is missed, and the check of the true distance removes the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut, ids_and_texts, shuffled, small_batches, small_bytes, texts
from .graph import _forest, connected_components

BITS = 64
#: Bits of the fingerprints of keep_first_similar; of the first 128, a pair at Jaccard 0.8 differs in 19 on average, with a deviation of 4.
WIDE = 256
NEAR = 34
#: Bins of a node's sketch of its shingle set; a bin keeps the least hash that falls into it as 1 .. 15, 0 if none does.
BINS = 512
#: A pair is compared exactly if its sketches' share of equal bins is at most so many deviations below the similarity.
SPREAD = 3.0
#: Multipliers that make further hashes of a shingle's hash.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def fingerprint(text: str, shingle_words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[shingle_words - 1 :].tolist() if len(words) >= shingle_words else [len(line)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # a block at a time: the bit table takes 64 bytes a shingle
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long; a null or empty text has 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle_words, seed) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """One 64-bit mask for each non-zero vector of radius + 1 bits; the bits' vectors are dealt evenly."""
    space = (1 << (radius + 1)) - 1
    vector = [1 + (i * 7 + i // space) % space for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, space + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(radius: int):
    """Within a small bucket: every member joined to its group's smallest, groups by distance <= radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for members in b.column(0).to_pylist():
                x = np.unique(np.array(members, np.int64))
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                root = np.arange(len(x))
                while True:  # smallest neighbour's label until it settles
                    new = np.where(near, root[None, :], len(x)).min(1)
                    if (new == root).all():
                        break
                    root = new
                keep = root != np.arange(len(x))
                left.append(x[keep])
                right.append(x[root[keep]])
            flat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([flat(left), flat(right)], names=["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = 3, bucket_limit: int = 512) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose closure joins exactly the pairs within the radius.

    Buckets up to bucket_limit members are compared inside one task. A larger bucket is never
    gathered: each member is sent to all values within ceil(radius / 2) flips, and to those within
    floor(radius / 2) as a possible hub; a value's smallest hub is within the radius of everything
    that reached the value, and any pair within the radius shares such a value. Rows grow in
    proportion to the bucket there.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = shuffled(keyed, sizes, ["t", "key"])
    small_batches(fps.sparkSession)
    few = met.filter(F.col("n") <= bucket_limit).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_stars(radius), "a long, b long")

    near, far = radius // 2, radius - radius // 2
    flips = [(0, 0)]
    for _ in range(far):
        flips += [(f | (1 << i), n + 1) for f, n in flips for i in range(BITS) if not f >> i & 1]
    flips = sorted({f: n for f, n in flips if n == f.bit_count()}.items(), key=lambda x: (x[1], x[0]))
    spark = fps.sparkSession
    moves = F.broadcast(
        spark.createDataFrame(
            [(t, _signed(f), n) for t, m in enumerate(masks) for f, n in flips if not f & m], "t int, flip long, n_flips int"
        )  # fixed size: tables x values within reach in the bits that a table drops
    )
    many = met.filter(F.col("n") > bucket_limit).join(moves, "t").select("t", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "n_flips")
    hubs = many.filter(F.col("n_flips") <= near).groupBy("t", "key", "value").agg(F.min("fp").alias("b"))
    reached = shuffled(many, hubs, ["t", "key", "value"]).select(F.col("fp").alias("a"), "b")
    return few.unionByName(reached).filter("a <> b")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle_words: int = 3, seed: int = 42, bucket_limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Texts without words, null ones too, have fingerprint 0 and link like any other. Repeated rows
    stay; equal fingerprints are one node. Null ids come last: a group has a null component_id only
    if all its ids are null. An empty table gives an empty result; other columns are not read.
    """
    rows = cut(fingerprints(docs, shingle_words, seed, id_col, text_col))
    firsts = rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("first_id"))
    of_fp = _components(firsts, radius, bucket_limit).select("fp", F.nullif("component_id", F.lit(LAST_ID)).alias("component_id"))
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _components(firsts: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(fp, first_id) -> (fp, first_id, component, component_id): component is a fingerprint, component_id the least first_id."""
    groups = connected_components(near_links(firsts.select("fp"), radius, bucket_limit)).select(F.col("node").alias("fp"), "component")
    named = shuffled(firsts, groups, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(lowest, "component").select("fp", "first_id", "component", "component_id")


def keep_first(docs: DataFrame, radius: int = 3, shingle_words: int = 3, seed: int = 42, bucket_limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each near-duplicate group: its smallest id, null ids last.

    Rows that share that id and differ in text are told apart by a hash of the text; of wholly equal
    ones one stays. Groups that share an id, or have null ids only, each keep a row of their own.
    """
    row_id, row_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(F.col(text_col).cast("string"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle_words, seed) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "h", "fp"])

    keyed = docs.select(row_id.alias("id"), row_hash.alias("h"), F.col(text_col).cast("string").alias("text"))
    rows = cut(keyed.mapInArrow(run, "id long, h long, fp long"))
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.min(F.struct("id", "h")).alias("first"))
    named = _components(firsts.select("fp", "first_id"), radius, bucket_limit).join(firsts.select("fp", "first"), "fp")
    return _rows_of(docs, named.groupBy("component").agg(F.min("first").alias("first")), row_id, row_hash)


def _rows_of(docs: DataFrame, best: DataFrame, row_id: Column, row_hash: Column) -> DataFrame:
    """One row of docs for each (first.id, first.h) of best."""
    longer = max(map(len, docs.columns)) + 1  # so that no column of docs has these names
    own = [name.ljust(longer, "_") for name in ("__kept_id", "__kept_hash")]
    best = best.select(F.col("first.id").alias(own[0]), F.col("first.h").alias(own[1]))
    known = docs.withColumns({own[0]: row_id, own[1]: row_hash})
    return known.join(best, own, "left_semi").dropDuplicates(own).drop(*own)


def _shingles(line: bytes, shingle_words: int) -> set[bytes]:
    """The distinct shingles of a line of words parted by one space; a line of fewer words is one shingle."""
    words = line.split()
    return {b" ".join(words[i : i + shingle_words]) for i in range(max(1, len(words) - shingle_words + 1))}


def sketch(h: np.ndarray) -> bytes:
    """A set's size in four bytes, then half a byte for each bin of its hashes, from the least hash in it."""
    h = np.sort(h)
    bins, first = np.unique(h % np.uint64(BINS), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = (h[first] // np.uint64(BINS) % np.uint64(15)).astype(np.uint8) + 1
    return np.uint32(len(h)).tobytes() + (out[0::2] | out[1::2] << 4).tobytes()


def read_sketches(drawn: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bins), a row for each sketch."""
    raw = np.frombuffer(b"".join(drawn), np.uint8).reshape(len(drawn), 4 + BINS // 2)
    size = np.ascontiguousarray(raw[:, :4]).view(np.uint32)[:, 0].astype(np.int64)
    return size, np.concatenate((raw[:, 4:] & 15, raw[:, 4:] >> 4), axis=1)


def alike(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes n, m and bins x, y (a row each) may belong to sets of the similarity.

    The bins that either fills draw as many members of the union without replacement; of two sets just at
    the similarity the share of equal ones scatters as a draw from a union of that size does.
    """
    union = (n + m) / (1 + similarity)
    filled, same = ((x | y) > 0).sum(-1), ((x == y) & (x > 0)).sum(-1)
    left = np.clip(1 - filled / union, 0, 1)
    enough = same >= filled * similarity - SPREAD * np.sqrt(filled * similarity * (1 - similarity) * left) - 1
    return enough & (np.minimum(n, m) >= similarity * np.maximum(n, m))


def shingle_hashes(line: bytes, shingle_words: int, seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in _shingles(line, shingle_words)), np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Majority bits of WIDE / 64 hashes of every distinct shingle's hash, as WIDE zeros and ones."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(h), 1 << 15):
        x = h[at : at + (1 << 15), None] * _ODD[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return (counts * 2 > len(h)).astype(np.uint8)


def _tables(rows: int, similarity: float, miss: float) -> np.ndarray:
    """Sampled bit positions, a row for each table: so many that a pair at the similarity meets in none with chance miss.

    Two sets of Jaccard s have a cosine of 2s / (1 + s) or more, and each bit differs with the chance of their angle.
    """
    same = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    width = max(16, rows.bit_length() - 4)
    n = int(np.ceil(np.log(miss) / np.log1p(-(same**width))))
    rng = np.random.default_rng(7)
    return np.stack([rng.choice(WIDE, width, replace=False) for _ in range(n)])


#: A bucket's key holds the table's number above so many bits.
TABLE_BITS = 40


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's members, near are those with at most NEAR different bits of 128; (a, b) joins each to the smallest that nearness reaches."""
    for b in batches:
        members = b.column(0)
        at = np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))
        node, lo, hi = (f.to_numpy() for f in members.flatten().flatten())
        order = np.lexsort((node, at))
        at, node, lo, hi = at[order], node[order], lo[order].view(np.uint64), hi[order].view(np.uint64)
        n = len(at)
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for d in range(1, n):  # all members with the d-th after them in their bucket
            i = np.flatnonzero(at[d:] == at[:-d])
            if not len(i):
                break
            bits = np.bitwise_count(lo[i] ^ lo[i + d]).astype(np.int64) + np.bitwise_count(hi[i] ^ hi[i + d])
            i = i[bits <= NEAR]
            pairs.append((i, i + d))
        root = _least(n, *(np.concatenate([p[k] for p in pairs]) for k in (0, 1)))
        away = np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(node[root[away]])], names=["a", "b"])


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of n places that the links (x, y) reach from each."""
    root = np.arange(n)
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _near(keyed: DataFrame, bucket_limit: int) -> DataFrame:
    """Links (a, b) of nodes that may be similar, from (key, node, lo, hi).

    A bucket's members that nearness joins are linked. A larger bucket is never gathered: all its members are linked
    to its smallest. Every pair that shares a bucket and is near is joined by the links.
    """
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("b")).filter("n > 1"))
    met = shuffled(keyed, sizes, "key")
    few = met.filter(F.col("n") <= bucket_limit).groupBy("key").agg(F.collect_list(F.struct("node", "lo", "hi")).alias("m")).select("m").mapInArrow(_met, "a long, b long")
    many = met.filter((F.col("n") > bucket_limit) & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b")
    return few.unionByName(many)


#: Share of the range of hashes that is counted in all texts; more leaves fewer texts to compare and shuffles more.
COUNTED = 0.3
#: Hashes that a task gathers before it passes them on, and groups that they are dealt to, at least; more hashes have more groups.
GATHER = 1_000_000
DEALS = 256
#: Holders of a hash among those gathered above which a task counts them itself and passes on one.
COMMON = 64


def _spare(n: Column, similarity: float) -> Column:
    """How many of its n hashes a set may hold that a similar set does not."""
    return F.floor((1 - similarity) * n + 1e-6)


def _line(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


def _low(h: np.ndarray) -> np.ndarray:
    """The hashes that are counted in all texts."""
    return h[h < np.uint64(int(COUNTED * (1 << 64)))]


def _dealt(shingle_words: int, deals: int):
    """From (text): (deal, codes, nodes, known, held, times): rows of arrays, dealt by ranges of hashes.

    codes are places of hashes in their range, nodes their holders. Of a hash that very many hold one holder goes on, marked as known,
    and the others are counted here, in held and times.
    """
    width = int(COUNTED * (1 << 64)) // deals + 1
    shift = max(0, width.bit_length() - 32)

    def packed(h: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h)
        h, node = h[order], node[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
        known = np.zeros(len(h), np.uint8)
        known[first] = size[first] > COMMON
        held, times = np.unique(node[size > COMMON], return_counts=True)
        stay = (size <= COMMON) | (known > 0)
        h, node, known = h[stay], node[stay], known[stay]
        deal = h // np.uint64(width)
        code = (h - deal * np.uint64(width) >> np.uint64(shift)).astype(np.uint32)
        cuts = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
        parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]))
        columns = [pa.array([x[i:j].tobytes() for i, j in parts], pa.binary()) for x in (code, node, known)]
        at = int(node[0]) % len(parts)
        counted = [pa.array([x.tobytes() if k == at else b"" for k in range(len(parts))], pa.binary()) for x in (held, times.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(deal[cuts].astype(np.int32)), *columns, *counted], names=["deal", "codes", "nodes", "known", "held", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes, nodes, gathered = [], [], 0
        for b in batches:
            if len(seen) > 100_000:
                seen.clear()
            for t in texts(b):
                line = _line(t)
                node = xxhash.xxh3_64_intdigest(line)
                if node in seen:
                    continue
                seen.add(node)
                h = _low(shingle_hashes(line, shingle_words))
                hashes.append(h)
                nodes.append(np.full(len(h), node, np.uint64).view(np.int64))
                gathered += len(h)
                if gathered >= GATHER:
                    yield packed(np.concatenate(hashes), np.concatenate(nodes))
                    hashes, nodes, gathered = [], [], 0
        if gathered:
            yield packed(np.concatenate(hashes), np.concatenate(nodes))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """(node, n): how many of the group's hashes the node and another one hold, no fewer."""
    codes, nodes, known, held, times = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("codes", np.uint32), ("nodes", np.int64), ("known", np.uint8), ("held", np.int64), ("times", np.int64)))
    order = np.lexsort((nodes, codes))
    codes, nodes, known = codes[order], nodes[order], known[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    many = (np.minimum.reduceat(nodes, first) != np.maximum.reduceat(nodes, first)) | (np.maximum.reduceat(known, first) > 0)
    fresh = np.r_[True, (codes[1:] != codes[:-1]) | (nodes[1:] != nodes[:-1])]  # copies of a text in two tasks
    some = np.repeat(many, np.diff(np.r_[first, len(codes)])) & fresh & (known == 0)
    # a holder that went on as known was counted by its task
    node, at = np.unique(np.concatenate((nodes[some], held)), return_inverse=True)
    n = np.bincount(at, np.concatenate((np.ones(some.sum()), times)), len(node)).astype(np.int64)
    return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())})


def _partnered(given: DataFrame, nodes: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The nodes that may have a similar one: all but those too few of whose counted hashes another text holds; nothing is missed.

    A set shares all but _spare(n) of its n hashes with a similar one, so of its `low` counted ones it shares low - _spare(n) or more.
    """
    total = nodes.agg(F.coalesce(F.sum("low"), F.lit(0)).alias("n")).first()["n"]
    dealt = given.select("text").mapInArrow(_dealt(shingle_words, max(DEALS, total // GATHER)), "deal int, codes binary, nodes binary, known binary, held binary, times binary")
    met = dealt.groupBy("deal").applyInArrow(_repeated, "node long, n long").groupBy("node").agg(F.sum("n").alias("met"))
    return shuffled(nodes, met, "node", "left").filter(F.coalesce("met", F.lit(0)) + _spare(F.col("n"), similarity) >= F.col("low"))


def _sharing(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar pairs, from (node, n, h), and few others.

    With the rarest hash first, the first _spare(n) + 1 hashes of two similar sets have one in common. The holders of a hash are
    linked in the order of their sizes, wherever the next size is near enough; what lies between two similar sizes is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, n, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                h = np.frombuffer(h, np.int64)
                for at in range(0, len(h), 1 << 16):
                    part = pa.array(h[at : at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), n, np.int32)), part], names=["node", "n", "h"])

    flat = sets.select("node", "n", "h").mapInArrow(run, "node long, n int, h long")
    often = flat.withColumn("often", F.count("*").over(Window.partitionBy("h"))).filter("often > 1")
    of_node = Window.partitionBy("node")
    placed = often.withColumn("place", F.row_number().over(of_node.orderBy("often", "h"))).withColumn("shared", F.count("*").over(of_node))
    first = placed.filter(F.col("n") - F.col("shared") + F.col("place") <= _spare(F.col("n"), similarity) + 1).select("h", "node", "n")
    order = Window.partitionBy("h").orderBy("n", "node")
    linked = first.withColumn("b", F.lag("node").over(order)).withColumn("before", F.lag("n").over(order))
    return linked.filter(F.col("before") >= F.col("n") - _spare(F.col("n"), similarity)).select(F.col("node").alias("a"), "b")


#: Hashes in a block of a cluster, and what a member adds to its own number of them, so that a block has at most some thousand members.
BLOCK = 200_000
MEMBER = 100
#: Members of a block, those with the most similar others in it, that all blocks of the cluster are compared with first.
HUBS = 4
#: Products of two blocks' counts of a hash below which the pairs that share it are listed, not multiplied as a matrix.
LISTED = 1 << 14


def _overlaps(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """How many hashes each set of x shares with each of y; x holds the sets one after the other, nx their sizes."""
    of_x, of_y = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    keys = np.intersect1d(x, y)  # of both, once each
    out = np.zeros((len(nx), len(ny)), np.float32)  # exact below 2 ** 24
    if not len(keys):
        return out
    sides = []
    for h, of in ((x, of_x), (y, of_y)):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        held = keys[at] == h
        at, of = at[held], of[held]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], of[order], np.bincount(at, minlength=len(keys))))
    (at_x, of_x, fx), (at_y, of_y, fy) = sides
    listed = fx * fy < LISTED
    first_y = np.cumsum(fy) - fy
    some = np.flatnonzero(listed[at_x])
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(fy[at_x[some]]) // (1 << 21))) + 1):  # some million pairs at a time
        times = fy[at_x[part]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(of_x[part], times) * len(ny) + of_y[np.repeat(first_y[at_x[part]], times) + step]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    column = np.cumsum(~listed) - 1
    wide = ~listed[at_x], ~listed[at_y]
    cx, ox, cy, oy = column[at_x[wide[0]]], of_x[wide[0]], column[at_y[wide[1]]], of_y[wide[1]]
    for low in range(0, int((~listed).sum()), 1024):
        a, b = np.zeros((len(nx), 1024), np.float32), np.zeros((len(ny), 1024), np.float32)
        for to, c, o in ((a, cx, ox), (b, cy, oy)):
            here = slice(*np.searchsorted(c, (low, low + 1024)))
            to[o[here], c[here] - low] = 1
        out += a @ b.T
    return out


def _alike_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    both = _overlaps(x, nx, y, ny).astype(np.float64)
    return np.nonzero(both >= similarity * (nx[:, None] + ny[None, :] - both))


def _sets(members: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, groups, hashes one set after the other, sizes) of (node, of, h) structs."""
    node, of, h = members.values.flatten()
    h = h.to_pylist()
    return node.to_numpy(), of.to_numpy(), np.frombuffer(b"".join(h), np.uint64), np.array([len(v) // 8 for v in h], np.int64)


def _within(similarity: float):
    """From blocks (m): (a, b, degree) of members similar to others, joined to the smallest reached; degree is null but for the HUBS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, members in zip(batch.column(0), batch.column(1)):
                node, _, h, n = _sets(members)
                x, y = _alike_pairs(h, n, h, n, similarity)
                root, degree = _least(len(node), x, y), np.bincount(x, minlength=len(node)) - 1
                some = np.flatnonzero(degree > 0)
                some = some[np.argsort(-degree[some], kind="stable")]
                top = pa.array([int(d) if k < HUBS else None for k, d in enumerate(degree[some])], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * len(some), pa.int64()), pa.array(node[some]), pa.array(node[root[some]]), top], names=["cluster", "a", "b", "degree"])

    return run


def _between(similarity: float):
    """From two blocks (m, o): links (a, b) that join the groups of similar members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, others in zip(batch.column(0), batch.column(1)):
                (_, of, h, n), (_, to, g, k) = _sets(members), _sets(others)
                x, y = _alike_pairs(h, n, g, k, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in _forest(of[x], to[y])], names=["a", "b"])

    return run


def _blocks(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, part, parts, m): the members (node, of, h) of each group of by, dealt into blocks of about BLOCK hashes."""
    weight = F.sum(F.length("h") / 8 + MEMBER)
    parts = sets.groupBy(*by).agg(F.ceil(weight / BLOCK).cast("int").alias("parts"))
    dealt = shuffled(sets, parts, by).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    return dealt.groupBy(*by, "parts", "part").agg(F.collect_list(F.struct("node", "of", "h")).alias("m"))


def _groups(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the nodes that similar pairs within a cluster join, all pairs compared; from (cluster, node, of, h), of being the node.

    Each block of a cluster is compared with itself, then, if the cluster has several, with the cluster's hubs. What is still
    apart from the cluster's largest group is compared with all of the cluster, two blocks at a time.
    """
    small_bytes(sets.sparkSession, 16 * BLOCK)
    blocks = _blocks(sets, ["cluster"])
    within = cut(blocks.select("cluster", "m").mapInArrow(_within(similarity), "cluster long, a long, b long, degree long"))
    large = cut(blocks.groupBy("cluster").agg(F.max("parts").alias("parts")).filter("parts > 1"))
    if large.isEmpty():
        return connected_components(within.select("a", "b"))
    sets = cut(shuffled(sets, large.select("cluster"), "cluster"))
    best = F.explode(F.slice(F.sort_array(F.collect_list(F.struct("degree", "a")), asc=False), 1, 4 * HUBS))
    hubs = within.filter("degree is not null").join(large, "cluster").groupBy("cluster", "parts").agg(best.alias("hub")).select("parts", F.col("hub.a").alias("node"))
    hubs = shuffled(sets, hubs, "node").groupBy("cluster", "parts").agg(F.collect_list(F.struct("node", "of", "h")).alias("o"))
    hubs = hubs.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "o")
    reached = shuffled(_blocks(sets, ["cluster"]), hubs, ["cluster", "part"]).select("m", "o").mapInArrow(_between(similarity), "a long, b long")
    links = within.select("a", "b").unionByName(cut(reached))
    group = cut(connected_components(links))

    sets = shuffled(sets.drop("of"), group, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("of"), "h")
    main = sets.groupBy("cluster", "of").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("of", F.struct("n", "of")).alias("main"), F.count("*").alias("groups"))
    apart = _blocks(shuffled(sets, main.filter("groups > 1"), "cluster").withColumn("side", (F.col("of") != F.col("main")).cast("int")), ["cluster", "side"])
    apart = cut(apart)
    n = apart.groupBy("cluster").agg(*[F.coalesce(F.max(F.when(F.col("side") == k, F.col("parts"))), F.lit(0)).alias(f"parts{k}") for k in (0, 1)])
    told = shuffled(apart, n, "cluster")
    each = lambda low, high: F.explode(F.expr(f"if({low} <= {high}, sequence({low}, {high}), array())"))
    one = told.select("cluster", "side", "part", each("if(side = 0, 0, part)", "parts1 - 1").alias("other"), "m")
    rest = told.filter("side = 1").select("cluster", "parts0", F.col("part").alias("other"), F.col("m").alias("o"))
    two = rest.select("cluster", F.lit(0).alias("side"), each("0", "parts0 - 1").alias("part"), "other", "o").unionByName(
        rest.select("cluster", F.lit(1).alias("side"), each("0", "other").alias("part"), "other", "o")
    )
    over = shuffled(one, two, ["cluster", "side", "part", "other"]).select("m", "o").mapInArrow(_between(similarity), "a long, b long")
    return connected_components(links.unionByName(over))


def keep_first_similar(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, miss: float = 0.02, bucket_limit: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each group joined by pairs of the Jaccard similarity or more.

    Texts of the same lower-case words are one node, a node is the set of the 64-bit hashes of its word shingles. Nodes that can have
    no similar one, as other texts hold too few of their hashes, stay by themselves. Of the rest, those are linked that agree in the
    sampled bits of some table and in most of 128 bits (miss is the share of pairs just at the similarity that would meet in no
    table if bits were independent), and those that share one of their rarest hashes, as all similar pairs do. Links make clusters,
    and within a cluster all pairs of sets are compared, whatever the cluster's size, so that no pair is lost. Pairs are never
    written out. A group's smallest id stays, null ids last, ties by a hash of the text.
    """
    spark = docs.sparkSession
    row_id, row_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(F.col(text_col).cast("string"))
    small_batches(spark)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, lows = [], [], []
            for t in texts(b):
                line = _line(t)
                h = shingle_hashes(line, shingle_words)
                nodes.append(xxhash.xxh3_64_intdigest(line))
                sizes.append(len(h))
                lows.append(len(_low(h)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(lows, pa.int32())], names=["id", "h", "node", "n", "low"])

    given = docs.select(row_id.alias("id"), row_hash.alias("h"), F.col(text_col).cast("string").alias("text"))
    rows = given.mapInArrow(facts, "id long, h long, node long, n int, low int")
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("id", "h")).alias("first"), F.min("n").alias("n"), F.min("low").alias("low")))
    wanted = cut(_partnered(given, nodes, similarity, shingle_words).select("node", F.col("first.id").alias("id"), F.col("first.h").alias("h")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [shingle_hashes(_line(t), shingle_words) for t in texts(b)]
            prints = [np.packbits(wide_fingerprint(x), bitorder="little").tobytes() for x in h]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in h], pa.int32()), pa.array(prints, pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], names=["node", "n", "fp", "h"])

    lines = given.join(wanted, ["id", "h"]).select("node", "text").dropDuplicates(["node"])
    sets = cut(lines.mapInArrow(hashes, "node long, n int, fp binary, h binary"))
    tables = _tables(sets.count(), similarity, miss)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(packed, axis=1, bitorder="little").astype(np.int64)
            key = np.stack([(t << TABLE_BITS) + bits[:, at] @ (1 << np.arange(len(at))) for t, at in enumerate(tables)], 1)
            of = pa.array(np.repeat(np.arange(b.num_rows), len(tables)))
            lo, hi = (pa.array(np.ascontiguousarray(packed[:, k : k + 8]).view(np.int64).ravel()) for k in (0, 8))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), b.column(0).take(of), lo.take(of), hi.take(of)], names=["key", "node", "lo", "hi"])

    keyed = sets.select("node", "fp").mapInArrow(keys, "key long, node long, lo long, hi long")
    clusters = connected_components(_near(keyed, bucket_limit).unionByName(_sharing(sets, similarity))).withColumnRenamed("component", "cluster")
    sets = cut(shuffled(sets, clusters, "node").select("cluster", "node", F.col("node").alias("of"), "h"))
    group = _groups(sets, similarity)
    named = shuffled(nodes, group, "node", "left").select(F.coalesce("component", "node").alias("component"), "first")
    return _rows_of(docs, named.groupBy("component").agg(F.min("first").alias("first")), row_id, row_hash)
