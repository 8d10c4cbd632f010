"""Removal of repeated byte strings across documents, with suffix arrays.

Every window of `length` bytes has one anchor: the smallest-hashed of its k-byte strings, leftmost
if several are equal. It depends on the window's bytes alone, so equal windows have equal anchors,
and a document falls into segments of consecutive windows with one anchor. A window holds at least
half of the bytes it has beside its anchor on the anchor's left or on its right, so each segment has
a left and a right part whose windows all hold one longer string, its key. Parts whose key
occurs in two documents meet in the bucket of their anchor; a suffix array over the bucket's
different segments, built by two-stage sorting, brings equal windows together, and adjacent common
prefixes of `length` or more mark them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, cut, ids_and_texts, parts, small_batches

#: Ends each segment in a bucket's text; no UTF-8 text holds this byte.
END = 0xFF
#: The copies of one text are dealt over this many keys.
SALTS = 16
#: Different segments of a bucket, about 2 MB of text; the number of buckets follows from it.
BUCKET_SEGMENTS = 32_768
#: Buckets of a shuffle partition, about 64 MB of text at most.
TASK_BUCKETS = 32


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; END behind the text."""
    v = np.concatenate((t, np.full(7, END, np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        v = (v[:-step] << np.uint64(8 * step)) | v[step:]
    return v


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than its successor; END follows the text, so a last run counts as smaller."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(change, np.arange(n))
    last = at == len(change)
    at = change[np.minimum(at, len(change) - 1)] if len(change) else np.zeros(n, np.int64)
    return last | (t[at] < t[np.minimum(at + 1, n - 1)])


def sort_directly(at: np.ndarray, v8: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the first `depth` (rounded up to 8) bytes of their suffixes, 8 bytes at a time within ties."""
    pad = np.uint64((1 << 64) - 1)
    key = lambda p, d: np.where(p + d < len(v8), v8[np.minimum(p + d, len(v8) - 1)], pad)
    k = v8[at]
    order = np.argsort(k)
    at, k = at[order], k[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(at) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        group = np.cumsum(first)
        tied = ~first
        tied[:-1] |= ~first[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part, g = at[where], group[where]
        k = key(part, d)
        order = np.lexsort((k, g))
        part, k, g = part[order], k[order], g[order]
        at[where] = part
        first[where[1:]] |= (k[1:] != k[:-1]) & (g[1:] == g[:-1])
    return at


def needed_for(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The wanted suffixes and all that induce them: their successors up to the next directly sorted one."""
    at, sorted_ = np.flatnonzero(wanted), np.flatnonzero(small)
    stop = sorted_[np.searchsorted(sorted_, at)] + 1  # the last suffix always counts as smaller
    n = len(small) + 1
    return np.cumsum(np.bincount(at, minlength=n) - np.bincount(stop, minlength=n))[:-1] > 0


def suffix_array(t: np.ndarray, depth: int = 1 << 30, v8: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of a byte array in order of their first `depth` bytes (END behind the text).

    Stage one sorts only the suffixes smaller than their successors. Stage two scans the buckets of
    first bytes upwards: a suffix in order puts its predecessor, if that is larger than it, next in
    the predecessor's bucket; in a bucket those come before the directly sorted ones. Where only some
    suffixes are wanted (a mask), both stages leave out those that are neither wanted nor induce a wanted one.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    v8 = words_at(t) if v8 is None else v8
    small = smaller_than_next(t)
    if wanted is None:
        direct, large = np.flatnonzero(small), ~small
    else:
        needed = needed_for(wanted, small)
        direct, large = np.flatnonzero(small & needed), ~small & needed
    direct = sort_directly(direct, v8, min(depth, n + 8))
    bound = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        run = [part]
        while len(part):  # predecessors with the same first byte follow in this bucket
            part = part[part > 0] - 1
            part = part[(t[part] == c) & large[part]]
            run.append(part)
        run.append(direct[bound[c] : bound[c + 1]])
        whole = np.concatenate(run)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(t[before] > c) & large[before]]
        if len(before):
            first = t[before]
            before = before[np.argsort(first, kind="stable")]
            stops = np.cumsum(np.bincount(first, minlength=256))
            for b in np.flatnonzero(np.bincount(first, minlength=256)):
                waiting[b].append(before[stops[b - 1] if b else 0 : stops[b]])
        waiting[c] = []
    whole = np.concatenate(out)
    return whole if wanted is None else whole[wanted[whole]]


def common_prefixes(sa: np.ndarray, v8: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to limit, of the prefix that each suffix shares with the one before it (0 for the first)."""
    out = np.zeros(len(sa), np.int64)
    pad = np.uint64((1 << 64) - 1)
    live = np.arange(1, len(sa))
    for d in range(0, limit, 8):
        a, b = sa[live - 1] + d, sa[live] + d
        x = np.where(a < len(v8), v8[np.minimum(a, len(v8) - 1)], pad) ^ np.where(b < len(v8), v8[np.minimum(b, len(v8) - 1)], pad)
        same = x == 0
        for k in range(8):
            out[live] += x < np.uint64(1 << (56 - 8 * k)) if k < 7 else same
        live = live[same]
    return np.minimum(out, limit)


def _mixed(v8: np.ndarray, n: int, anchor_bytes: int) -> np.ndarray:
    """A 64-bit hash of the anchor_bytes (a multiple of 8) from each of n positions."""
    h = np.zeros(n, np.uint64)
    for at in range(0, anchor_bytes, 8):
        h = (h ^ v8[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _strings(v8: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes (8 or more) from each of some positions."""
    h = np.full(len(at), seed, np.uint64)
    for step in [*range(0, size - 8, 8), size - 8]:
        h = (h ^ v8[at + step]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _segments(raw: list[bytes], length: int, anchor_bytes: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"".join(raw), np.uint8)
    n = len(t) - length + 1
    if n <= 0:
        return NONE
    v8 = words_at(t)
    h = _mixed(v8, len(t) - anchor_bytes + 1, anchor_bytes)
    # the smallest of the window's hashes, leftmost on ties: high bits of the hash, then the position
    bits = np.uint64(max(1, len(t).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, have = length - anchor_bytes + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    where = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n, bool)
    for a, s in zip(begin.tolist(), sizes.tolist()):
        if s >= length:
            inside[a : a + s - length + 1] = True
    new = np.ones(n, bool)
    new[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True])))
    long = np.flatnonzero(sizes >= length)  # only these have windows
    doc = long[np.searchsorted(begin[long], first, side="right") - 1]
    half = (length - anchor_bytes) // 2
    at = where[first]
    n_left = np.clip(at - half - first + 1, 0, last - first + 1)  # windows that start half or more before the anchor
    left, right = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    some = n_left > 0
    left[some] = _strings(v8, at[some] - half, anchor_bytes + half, 1)
    some = n_left <= last - first
    right[some] = _strings(v8, at[some], anchor_bytes + half, 2)
    return doc, first - begin[doc], last - first + 1, n_left, h[at], left, right


NONE = (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 3)


class Segments:
    """Segments of windows with one anchor, of many texts: arrays doc (the text's index), first (byte
    offset of the first window), n (windows), n_left (those of the left part) and 64-bit hashes of the
    anchor's bytes (anchor) and of the parts' keys (left and right; no meaning where a part is empty).

    Texts are taken in groups of about group_bytes, which bounds the arrays; a single longer text is a group.
    """

    def __init__(self, raw: list[bytes], length: int, anchor_bytes: int = 24, group_bytes: int = 1 << 21) -> None:
        found, at = [], 0
        self.raw, self.length = raw, length
        while at < len(raw):
            stop, held = at, 0
            while stop < len(raw) and (stop == at or held + len(raw[stop]) <= group_bytes):
                held += len(raw[stop])
                stop += 1
            doc, *rest = _segments(raw[at:stop], length, anchor_bytes)
            found.append((doc + at, *rest))
            at = stop
        self.doc, self.first, self.n, self.n_left, self.anchor, self.left, self.right = map(np.concatenate, zip(*(found or [NONE])))

    def halves(self) -> tuple[np.ndarray, ...]:
        """(key, doc, first, n) of all parts that have windows, left ones before right ones."""
        a, z = np.flatnonzero(self.n_left), np.flatnonzero(self.n_left < self.n)
        key = np.concatenate((self.left[a], self.right[z]))
        first = np.concatenate((self.first[a], self.first[z] + self.n_left[z]))
        return key, np.concatenate((self.doc[a], self.doc[z])), first, np.concatenate((self.n_left[a], (self.n - self.n_left)[z]))

    def bodies(self, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes that some runs of windows cover."""
        raw, more = self.raw, self.length - 1
        return [raw[d][f : f + k + more] for d, f, k in zip(doc.tolist(), first.tolist(), n.tolist())]


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _buckets(spark) -> int:
    """Log2 of the number of anchor buckets; it follows the session's shuffle partitions."""
    return min(16, max(4, (parts(spark) - 1).bit_length()))


def _part_keys(length: int, log_buckets: int):
    """For each batch and bucket: 32 bits of the different keys, those of one text, and those of several with their occurrences and different bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Segments(_bytes(b), length)
            top, doc, begin, n = s.halves()
            top >>= np.uint64(32 - log_buckets)  # the bucket's bits and 32 more
            order = np.lexsort((doc, top))
            top, doc, begin, n = top[order], doc[order], begin[order], n[order]
            first = np.concatenate(([True], top[1:] != top[:-1])) if len(top) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            stop = np.concatenate((at[1:], [len(top)])) if len(at) else at
            several = doc[at] != doc[stop - 1]
            key, bucket = (top[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (top[at] >> np.uint64(32)).astype(np.int32)
            times, kinds = (stop - at).astype(np.uint32), np.ones(len(at), np.uint32)
            for k in np.flatnonzero(several).tolist():
                some = slice(at[k], stop[k])
                kinds[k] = len(set(s.bodies(doc[some], begin[some], n[some])))
            out: dict[str, list] = {"bucket": [], "single": [], "multi": []}
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                out["bucket"].append(int(bucket[a]))
                many = several[a:z]
                out["single"].append(key[a:z][~many].tobytes())
                out["multi"].append(np.stack((key[a:z][many], times[a:z][many], kinds[a:z][many])).tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("single", pa.binary()), ("multi", pa.binary())]))

    return run


def _repeated(bits: int, most_places: int, most_bodies: int):
    """A bucket's part of the bit table, a bit for each key that more than one text has; and the hot keys."""

    def run(table: pa.Table) -> pa.Table:
        single = np.frombuffer(b"".join(table.column("single").to_pylist()), np.uint32)
        multi = np.concatenate([np.frombuffer(x, np.uint32).reshape(3, -1) for x in table.column("multi").to_pylist()], axis=1)
        key, at = np.unique(np.concatenate((single, multi[0])), return_inverse=True)
        once = np.ones(len(single))
        times = np.bincount(at, np.concatenate((once, multi[1])), len(key))
        kinds = np.bincount(at, np.concatenate((once, multi[2])), len(key))
        marks = np.zeros(1 << bits, np.uint8)
        marks[key[times > 1] >> np.uint32(32 - bits)] = 1
        bucket = table.column("bucket")[0].as_py()
        hot = (np.int64(bucket) << 32) | key[(times > most_places) | (kinds > most_bodies)].astype(np.int64)
        meet = int(kinds[times > 1].sum())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary()), "meet": [meet], "hot": pa.array([hot], pa.list_(pa.int64()))})

    return run


class _Met:
    """The windows of a batch whose part's key is marked, of hot keys or of the others: runs doc, first, n and their anchor."""

    def __init__(self, b: pa.RecordBatch, length: int, marks: tuple[bytes, np.ndarray], table_bits: int, log_buckets: int, want_hot: bool) -> None:
        bits, hot = np.frombuffer(marks[0], np.uint8), marks[1]
        self.ids, self.tks = b.column(0).to_numpy(), b.column(1).to_numpy()
        self.s = s = Segments(_bytes(b), length)

        def met(key: np.ndarray) -> np.ndarray:
            k = (key >> np.uint64(64 - table_bits)).astype(np.int64)
            out = (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)
            return out & (np.isin((key >> np.uint64(32 - log_buckets)).astype(np.int64), hot) == want_hot) if len(hot) or want_hot else out

        if want_hot:  # parts of one key stay apart
            key, doc, first, n = s.halves()
            at = np.flatnonzero(met(key))
            self.doc, self.first, self.n = doc[at], first[at], n[at]
        else:
            left, right = met(s.left) & (s.n_left > 0), met(s.right) & (s.n_left < s.n)
            at = np.flatnonzero(left | right)
            skip = np.where(left, 0, s.n_left)[at]
            self.doc, self.first, self.n = s.doc[at], s.first[at] + skip, np.where(right, s.n, s.n_left)[at] - skip
            self.anchor = s.anchor[at]


def _packed_segments(length: int, marks, table_bits: int, log_buckets: int, n_buckets: int):
    """For each batch and bucket one row: the different bodies and where they stand, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            m = _Met(b, length, marks.value, table_bits, log_buckets, False)
            bucket = (m.anchor % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, doc_of, first, n = bucket[order], m.doc[order], m.first[order], m.n[order]
            out: dict[str, list] = {c: [] for c in ("bucket", "bodies", "sizes", "places")}
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                part = slice(a, z)
                body: dict[bytes, int] = {}
                which = np.array([body.setdefault(x, len(body)) for x in m.s.bodies(doc_of[part], first[part], n[part])], np.uint32)
                docs, doc = np.unique(doc_of[part], return_inverse=True)
                out["bucket"].append(int(bucket[a]))
                out["bodies"].append(press(b"".join(body)))
                out["sizes"].append(press(np.fromiter(map(len, body), np.uint16, len(body)).tobytes()))
                places = (m.ids[docs].astype(np.int64), m.tks[docs].astype(np.int64), which, doc.astype(np.uint32), first[part].astype(np.uint32))
                out["places"].append(press(np.array([len(docs), z - a], np.int64).tobytes() + b"".join(p.tobytes() for p in places)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("bodies", "sizes", "places")]]))

    return run


def _listed_segments(length: int, marks, table_bits: int, log_buckets: int):
    """A row for each part of a hot key: (id, tk, first, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _Met(b, length, marks.value, table_bits, log_buckets, True)
            bodies = pa.array(m.s.bodies(m.doc, m.first, m.n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(m.ids[m.doc]), pa.array(m.tks[m.doc]), pa.array(m.first.astype(np.int32)), bodies], names=["id", "tk", "first", "body"])

    return run


def _together(body: list[bytes], length: int, most: int) -> list[np.ndarray]:
    """Bodies in lists of about `most` or fewer; two with an equal window are in one list together, if not in all that one is in."""
    if len(body) <= most:
        return [np.arange(len(body))]
    s = Segments(body, length)  # each body is one segment, cut from a longer text
    out = []
    for key, some in ((s.left, s.n_left > 0), (s.right, s.n_left < s.n)):
        at = np.flatnonzero(some)
        at = at[np.argsort(key[at], kind="stable")]
        new = np.flatnonzero(np.concatenate(([True], key[at[1:]] != key[at[:-1]]))) if len(at) else at
        start = 0
        while start < len(at):  # whole keys only
            stop = new[np.searchsorted(new, start + most, side="right") - 1] if start + most < len(at) else len(at)
            if stop <= start:
                after = np.searchsorted(new, start, side="right")
                stop = new[after] if after < len(new) else len(at)
            out.append(s.doc[at[start:stop]])
            start = stop
    return out


def _repeats(body: list[bytes], lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, window) of windows that also start in a body with a smaller lo, by a suffix array over the bodies."""
    t = np.frombuffer(b"".join([x + b"\xff" for x in body]), np.uint8)
    size = np.fromiter(map(len, body), np.int64, len(body))
    begin = np.cumsum(size + 1) - size - 1
    v8 = words_at(t)
    owner = np.repeat(np.arange(len(body)), size + 1)
    is_window = np.arange(len(t)) - begin[owner] <= (size - length)[owner]
    sa = suffix_array(t, length, v8, is_window)
    run_of = np.cumsum(common_prefixes(sa, v8, length) < length) - 1
    own = lo[owner[sa]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.concatenate(([True], run_of[1:] != run_of[:-1]))))
    hit = sa[least[run_of] < own]
    return owner[hit], hit - begin[owner[hit]]


def _bucket_windows(length: int, most: int):
    """Suffix array over a bucket's different segments; for each place the windows that start in a smaller id's text."""

    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, int] = {}
        ids, tks, which, firsts = [], [], [], []
        for packed, sizes, places in zip(*(table.column(c).to_pylist() for c in ("bodies", "sizes", "places"))):
            text, stops = open_(packed), np.cumsum(np.frombuffer(open_(sizes), np.uint16).astype(np.int64)).tolist()
            number = np.array([known.setdefault(text[x:y], len(known)) for x, y in zip([0, *stops[:-1]], stops)], np.int64)
            raw = open_(places)
            n_docs, n = np.frombuffer(raw, np.int64, 2).tolist()
            at = 16 + 16 * n_docs
            own, doc, first = (np.frombuffer(raw, np.uint32, n, at + 4 * n * k) for k in range(3))
            ids.append(np.frombuffer(raw, np.int64, n_docs, 16)[doc])
            tks.append(np.frombuffer(raw, np.int64, n_docs, 16 + 8 * n_docs)[doc])
            which.append(number[own])
            firsts.append(first.astype(np.int32))
        body = list(known)
        del known
        ids, tks, which, firsts = map(np.concatenate, (ids, tks, which, firsts))
        lo = np.full(len(body), np.iinfo(np.int64).max)
        np.minimum.at(lo, which, ids)

        n = np.fromiter(map(len, body), np.int64, len(body)) - length + 1
        begin = np.cumsum(n) - n
        flags = np.zeros(int(n.sum()), bool)  # a flag for each window
        for part in _together(body, length, most):
            at, w = _repeats([body[i] for i in part.tolist()], lo[part], length)
            flags[begin[part[at]] + w] = True
        some = np.zeros(len(body), bool)
        some[np.searchsorted(begin, np.flatnonzero(flags), side="right") - 1] = True

        later = ids > lo[which]  # the whole segment also starts in a smaller id's text
        out = np.flatnonzero(later | some[which])
        hits = [None if z else np.flatnonzero(flags[begin[w] : begin[w] + n[w]]).astype(np.int32) for w, z in zip(which[out].tolist(), later[out].tolist())]
        return pa.table({"id": ids[out], "tk": tks[out], "first": firsts[out], "n": n[which[out]].astype(np.int32), "hits": pa.array(hits, pa.list_(pa.int32()))})

    return run


def _removed(raw: list[bytes], copy: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int) -> Iterator[tuple[int, list[int], bytes]]:
    """For each text: bytes removed, the edges of removed runs, and what is left; runs to remove come as (text, start, stop)."""
    sizes = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1  # one byte between texts keeps their runs apart
    n = int(sizes.sum()) + len(raw) + 1
    whole = np.flatnonzero(copy & (sizes >= length))
    edge = np.bincount(np.concatenate((begin[doc] + start, begin[whole])), minlength=n)
    edge -= np.bincount(np.concatenate((begin[doc] + stop, begin[whole] + sizes[whole])), minlength=n)
    gone = np.cumsum(edge) > 0
    flip = np.flatnonzero(np.diff(np.concatenate(([False], gone)))) if n else np.zeros(0, np.int64)
    cut_at = np.searchsorted(flip, begin).tolist() + [len(flip)]
    for i, r in enumerate(raw):
        edges = (flip[cut_at[i] : cut_at[i + 1]] - begin[i]).tolist()
        kept, at = [], 0
        for x, y in zip(edges[::2], edges[1::2]):
            kept.append(r[at:x])
            at = y
        left = b"".join(kept) + r[at:] if edges else r
        yield len(r) - len(left), edges, left


def _apply(length: int, group_bytes: int = 1 << 23):
    """Spans to drop and the bytes that stay, from a document's marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, copy = _bytes(b), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            marks = b.column(3)
            doc = np.repeat(np.arange(len(raw)), np.array(pc.fill_null(pc.list_value_length(marks), 0)))
            each = marks.flatten()
            first, n, hits = each.field("first").to_numpy().astype(np.int64), each.field("n").to_numpy().astype(np.int64), each.field("hits")
            some = ~np.array(hits.is_null(), bool)  # the others are whole segments
            held = np.repeat(np.flatnonzero(some), np.array(pc.fill_null(pc.list_value_length(hits), 0))[some])
            starts = first[held] + hits.flatten().to_numpy()
            doc, start, stop = np.concatenate((doc[~some], doc[held])), np.concatenate((first[~some], starts)), np.concatenate((first[~some] + n[~some] - 1 + length, starts + length))
            order = np.argsort(doc, kind="stable")
            doc, start, stop = doc[order], start[order], stop[order]
            at = 0
            while at < len(raw):  # arrays over about group_bytes at once; a single longer text is a group
                to, size = at, 0
                while to < len(raw) and (to == at or size + len(raw[to]) <= group_bytes):
                    size += len(raw[to])
                    to += 1
                x, y = np.searchsorted(doc, (at, to))
                rows = {"doc_id": b.column(0)[at:to], "n_bytes": list(map(len, raw[at:to])), "n_removed": [], "spans": [], "kept": []}
                for removed, edges, left in _removed(raw[at:to], copy[at:to], doc[x:y] - at, start[x:y], stop[x:y], length):
                    rows["n_removed"].append(removed)
                    rows["spans"].append([{"start": u, "end": v} for u, v in zip(edges[::2], edges[1::2])])
                    rows["kept"].append(left)
                yield pa.RecordBatch.from_pydict(rows, OUT)
                at = to

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _hot_windows(met: DataFrame, length: int) -> DataFrame:
    """The same for anchors met too often for one task: windows are grouped by their bytes, which are pre-aggregated, and joined back."""
    bodies = met.groupBy("body").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    each = bodies.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("body") - length))).withColumn("window", F.expr(f"substring(body, at + 1, {length})"))
    least = each.groupBy("window").agg(F.min("lo").alias("least"))
    hits = each.join(least, "window").groupBy("body", "lo", "hi").agg(F.array_compact(F.collect_list(F.when(F.col("least") < F.col("lo"), F.col("at")))).alias("hits"))
    flagged = hits.filter("size(hits) > 0 or hi > lo").select("body", "lo", "hits")
    found = met.join(flagged, "body").filter("id > lo or size(hits) > 0")
    return found.select("id", "tk", "first", (F.octet_length("body") - (length - 1)).alias("n"), F.when(F.col("id") == F.col("lo"), F.col("hits")).alias("hits"))


def _text_key(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "md5")


def _with_text_key(rows: DataFrame) -> DataFrame:
    """Adds tk, 64 bits that tell different texts of one id apart: salts are tried until no id has two texts with one key."""
    for salt in range(100):
        keyed = rows.withColumn("tk", _text_key(salt))
        clash = keyed.groupBy("id", "tk").agg((F.min("md5") < F.max("md5")).alias("two")).filter("two")
        if clash.isEmpty():
            return keyed
    raise ValueError("texts of one id outnumber what 64-bit keys can tell apart")


def remove_repeats(docs: DataFrame, length: int = 50, most_places: int = 4_000_000, most_bodies: int = 65_536, table_bits: int = 27, copies_limit: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed byte runs), kept (the other bytes).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
    id. Exact copies of a text with a smaller id go whole; where they are few enough to broadcast
    (copies_limit rows) they are left out of the search, whose result is the same with or without
    them. Windows are searched only if their part's key may occur twice: a bit table of fixed size says
    so, and a full table only lets more through. The windows of a key with more than most_places
    places or most_bodies different parts are not gathered but grouped by their bytes
    instead. Such keys come to the driver, at most two for each most_bodies segments of the input.
    A bucket with more than most_bodies different segments gets a suffix array for each most_bodies or so.

    Very long texts are cut into segments, so a text is whole in one task only where its bytes are removed. Other
    columns of the table, whatever their names, are not read. Null texts count as empty. A null id comes last; documents with one id don't count against each
    other, so repeated rows get equal results. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = ids_and_texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _with_text_key(rows.withColumn("md5", F.md5("text")))
    keys = rows.select("id", "md5", "tk")
    firsts = keys.groupBy("md5").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one text may have very many copies
    salted = keys.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    copies = cut(salted.join(firsts, ["md5", "salt"]).filter("id > least").select("id", "tk").distinct())
    search = rows.select("id", "tk", "text")
    left_out = copies.count() <= copies_limit
    if left_out:
        search = search.join(F.broadcast(copies), ["id", "tk"], "left_anti")

    log_buckets = _buckets(spark)
    keyed = search.select("text").mapInArrow(_part_keys(length, log_buckets), "bucket int, single binary, multi binary")
    size = 1 << (table_bits - log_buckets - 3)
    table, hot, meet = bytearray(size << log_buckets), [], 0
    for r in keyed.groupBy("bucket").applyInArrow(_repeated(table_bits - log_buckets, most_places, most_bodies), "bucket int, bits binary, meet long, hot array<long>").collect():
        table[r.bucket * size : (r.bucket + 1) * size] = r.bits  # together 2 ** table_bits bits, whatever the input
        hot += r.hot
        meet += r.meet
    n_buckets = max(8 * parts(spark), meet // BUCKET_SEGMENTS)
    marks = spark.sparkContext.broadcast((bytes(table), np.array(sorted(hot), np.int64)))
    packed = search.mapInArrow(_packed_segments(length, marks, table_bits, log_buckets, n_buckets), "bucket int, bodies binary, sizes binary, places binary")
    if n_buckets > TASK_BUCKETS * parts(spark):
        packed = packed.repartition(n_buckets // TASK_BUCKETS, "bucket")
    where = packed.groupBy("bucket").applyInArrow(_bucket_windows(length, most_bodies), "id long, tk long, first int, n int, hits array<int>")
    if hot:
        met = search.mapInArrow(_listed_segments(length, marks, table_bits, log_buckets), "id long, tk long, first int, body binary")
        where = where.unionByName(_hot_windows(met, length))
    marked = where.groupBy("id", "tk").agg(F.collect_list(F.struct("first", "n", "hits")).alias("marked"))
    marked = marked.withColumn("copy", F.lit(False))
    if left_out:
        marked = marked.unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    joined = rows.select("id", "tk", "text").join(marked, ["id", "tk"], "left")
    joined = joined.select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "marked")
    return joined.mapInArrow(_apply(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
