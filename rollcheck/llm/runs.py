"""Runs of repeated words inside a document, found on a grammar of its word ids.

A run is a stretch of words with smallest period q and length at least max(12, 2q) that cannot be
extended. Every such run holds a stretch of 6 words that occurs again q words later, so only
stretches covered by 6-word strings that repeat in the document are looked at; nothing is lost by that.

Those stretches are compressed by Re-Pair: the most frequent adjacent pair becomes a new symbol until
no pair occurs twice. What remains is joined by a balanced tree of symbols used once. A run crosses the
boundary of the lowest symbol whose expansion holds it, so the runs across each symbol's own boundary,
computed once for the symbol, give all runs after they are moved to every place where the symbol is
derived. Parts of longer runs found inside smaller symbols are merged into them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, small_batches, texts

#: Least length of a run in words.
LEAST = 12
#: Words of the strings that a run must repeat: a run of period q has max(12 - q, q) or more words that recur q later.
ANCHOR = LEAST // 2


def words_of(text: str) -> list[bytes]:
    """Maximal stretches without the six ASCII white-space characters, which are what bytes.split parts at."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_stretches(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [start, end) covered by ANCHOR-word strings that occur twice in their document, LEAST words or longer."""
    m = len(ids) - ANCHOR + 1
    if m < 2:
        return []
    h = np.zeros(m, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(ANCHOR):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + m]
    h ^= (doc[:m].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(doc[:m] == doc[ANCHOR - 1 :])
    h = h[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int32)
    hit = at[twice]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + ANCHOR, -1)
    covered = np.zeros(len(ids) + 2, np.int8)
    covered[1:-1] = np.cumsum(step[:-1]) > 0
    # a document's first word starts a stretch of its own
    cuts = np.flatnonzero(np.diff(covered)).tolist()
    out = []
    for s, e in zip(cuts[::2], cuts[1::2]):
        inner = np.flatnonzero(np.diff(doc[s:e])) + s + 1
        edges = [s, *inner.tolist(), e]
        out += [(a, b) for a, b in zip(edges, edges[1:]) if b - a >= LEAST]
    return out


def grammar(seq: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Re-Pair of seq, whose symbols are >= 0; negative values are barriers and stay apart.

    Returns rules, each (left, right, place of its first use) for the symbols -1 - k, and what remains as
    (symbol, place). Symbols below zero in the result are rules, others words; barriers are left out. Among
    equally frequent pairs the one met first is taken, which keeps the derivations of long repeats flat.
    """
    n = len(seq)
    sym: list[int | None] = [s if s >= 0 else None for s in seq]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    count: dict[tuple[int, int], int] = {}
    born: dict[tuple[int, int], int] = {}
    for i in range(n - 1):
        a, b = sym[i], sym[i + 1]
        if a is not None and b is not None:
            places.setdefault((a, b), []).append(i)
    for pair, p in places.items():
        count[pair], born[pair] = len(p), len(born)
    heap = [(-c, born[p], p) for p, c in count.items() if c > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int, int]] = []
    while heap:
        c, order, pair = heapq.heappop(heap)
        now = count[pair]
        if now != -c:
            if now > 1:
                heapq.heappush(heap, (-now, order, pair))
            continue
        a, b = pair
        new = -1 - len(rules)
        first, fresh = -1, []
        for i in sorted(set(places.pop(pair))):
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            first = i if first < 0 else first
            p, r = prv[i], nxt[j]
            sym[i], sym[j] = new, None
            nxt[i] = r
            if r < n:
                prv[r] = i
                if (right := sym[r]) is not None:
                    count[b, right] = count.get((b, right), 0) - 1
                    fresh.append(((new, right), i))
            if p >= 0 and (left := sym[p]) is not None:
                count[left, a] = count.get((left, a), 0) - 1
                fresh.append(((left, new), p))
        count[pair] = 0
        if first < 0:
            continue
        rules.append((a, b, first))
        added = {}
        for q, i in fresh:
            # a pair noted here is gone if its right symbol was replaced in the same sweep
            if sym[i] == q[0] and nxt[i] < n and sym[nxt[i]] == q[1]:
                places.setdefault(q, []).append(i)
                count[q] = count.get(q, 0) + 1
                added[q] = None
        for q in added:
            born.setdefault(q, len(born))
            if count[q] > 1:
                heapq.heappush(heap, (-count[q], born[q], q))
    rest, i = [], 0
    while i < n:
        if sym[i] is not None:
            rest.append((sym[i], i))
        i = nxt[i]
    return rules, rest


def _z(s: list) -> list[int]:
    """Length of the longest common prefix of s and s[i:], for every i."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _rightward(t: list[int], x: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, q) of the stretches across x whose part right of x has q words or more."""
    y = len(t) - x
    most = min(y, len(t) // 2)
    if t[x - 1] not in t[x : x + most]:
        return
    ahead = _z(t[x:]) + [0]
    back = _z([*t[x - 1 :: -1], None, *t[x + most - 1 :: -1]])[x + 1 :]
    for q in range(1, most + 1):
        before, after = min(back[most - q], x), ahead[q]
        if before and before + after >= q and before + after + q >= LEAST:
            yield x - before, x + q + after, q


def crossing(t: list[int], x: int) -> list[tuple[int, int, int]]:
    """Repeats (start, end, smallest period) in t that hold t[x - 1] and t[x], as far as they reach in t."""
    if len(t) < LEAST:
        return []
    found: dict[tuple[int, int], int] = {}
    for s, e, q in _rightward(t, x):
        found[s, e] = min(q, found.get((s, e), q))
    n = len(t)
    for s, e, q in _rightward(t[::-1], n - x):
        found[n - e, n - s] = min(q, found.get((n - e, n - s), q))
    return [(s, e, q) for (s, e), q in found.items()]


def find_runs(seq: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of seq, by start and then period; negative values are barriers, each different."""
    rules, rest = grammar(seq)
    size: list[int] = []
    length = lambda s: size[-1 - s] if s < 0 else 1
    for a, b, _ in rules:
        size.append(length(a) + length(b))
    # join what remains between barriers by balanced trees
    uses: list[list[int]] = [[] for _ in rules]
    level, joined = rest, list(rules)
    tops: list[tuple[int, int]] = []
    while level:
        up, k = [], 0
        while k < len(level):
            s, at = level[k]
            if k + 1 < len(level) and level[k + 1][1] == at + length(s):
                t = level[k + 1][0]
                joined.append((s, t, at))
                size.append(length(s) + length(t))
                uses.append([])
                up.append((-len(joined), at))
                k += 2
            else:
                up.append((s, at))
                k += 1
        if len(up) == len(level):
            tops = up
            break
        level = up
    for s, at in tops:
        if s < 0:
            uses[-1 - s].append(at)
    own = [crossing(seq[at : at + size[k]], length(a)) for k, (a, b, at) in enumerate(joined)]
    if not any(own):
        return []
    found = []
    for k in range(len(joined) - 1, -1, -1):
        a, b, _ = joined[k]
        for at in uses[k]:
            if a < 0:
                uses[-1 - a].append(at)
            if b < 0:
                uses[-1 - b].append(at + length(a))
            found += [(q, at + s, at + e) for s, e, q in own[k]]
    merged: list[list[int]] = []
    for q, s, e in sorted(set(found)):
        if merged and merged[-1][0] == q and s <= merged[-1][2] - q:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([q, s, e])
    return sorted((s, e, q) for q, s, e in merged)


def runs_of_batch(batch: list[str]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, runs by start and then period) of every text."""
    known: dict[bytes, int] = {}
    words = [words_of(t) for t in batch]
    ids = [known.setdefault(w, len(known)) for ws in words for w in ws]
    doc = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    first = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).tolist()
    stretches: dict[int, list[tuple[int, int]]] = {}
    for s, e in repeated_stretches(np.array(ids, np.int64), doc):
        stretches.setdefault(int(doc[s]), []).append((s, e))
    for d, ws in enumerate(words):
        seq, place = [], []
        for k, (s, e) in enumerate(stretches.get(d, ())):
            seq += [-1 - k, *ids[s:e]]
            place += [-1, *range(s - first[d], e - first[d])]
        runs = [(place[s], place[s] + e - s, q) for s, e, q in find_runs(seq)] if seq else []
        yield ws, sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for s, e, q in runs:
            step[s + q] += 1
            step[e] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.

    runs is an array of (start, length, period) in words, by start and then period; collapsed is the text
    with each run cut to its first period, words joined by one space. A null or empty text has no words, no
    runs and an empty collapsed text. Repeated rows and null ids stay as they are; other columns, whatever
    their names, are not read. A text is worked on whole by one task, with memory in proportion to it; time is
    about proportional to the words that repeat, times the logarithm of their number.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, collapsed = [], [], []
            for ws, rs in runs_of_batch(texts(b)):
                n.append(len(ws))
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in rs])
                collapsed.append(collapse(ws, rs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
