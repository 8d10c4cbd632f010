import random
import re

import numpy as np
import xxhash
from rollcheck.llm import graph, simhash
from rollcheck.llm.graph import connected_components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(values, radius):
    out = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= radius and out[b] < out[a]:
                    out[a], changed = out[b], True
    return out


def test_covering_masks_cover_every_pair():
    rng = random.Random(1)
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & m == 0 for m in masks)


def test_links_small_and_large_buckets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(5)]
    values = set(base)
    for b in base:
        for _ in range(25):
            values.add(b ^ sum(1 << i for i in rng.sample(range(63), rng.randint(1, 5))))
    values = sorted(values)
    want = brute_components(values, 3)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (512, 1):
        got = {r.node: r.component for r in connected_components(simhash.near_links(df, 3, limit)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_near_duplicates_edge_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    body = [rng.choice(words) for _ in range(300)]
    near = body[:]
    near[150] = "changed"
    rows = [(5, " ".join(body), 1), (3, " ".join(near), 2), (9, None, 3), (8, "", 4), (7, "  \n", 5), (1, "One TWO", 6), (2, "one two", 7), (2, "one two", 7), (None, "solo text here now", 8), (10, "x" * 200_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fp % 2**64): r.component_id for r in got}
    fps = {brute_fp(t) for _, t, _ in rows}
    assert {k[1] for k in by} == fps
    comp = brute_components(sorted(fps), 3)
    for d, t, _ in rows:
        ids = [i for i, u, _ in rows if comp[brute_fp(u)] == comp[brute_fp(t)] and i is not None]
        assert by[(d, brute_fp(t))] == (min(ids) if ids else None)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_first_keeps_a_row_of_every_group(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five"), (7, "red green blue white"), (7, "north south east west"), (9, "red green blue white")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in simhash.keep_first(df).collect()}
    assert got == set(rows[:4])


def test_similar_texts_are_one_group(spark):
    rng = random.Random(4)
    body = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    near = [[*b[:75], "x", *b[75:150], "y", *b[150:225], "z", *b[225:]] for b in body]  # Jaccard 0.9
    far = [[w if i % 9 else "v" for i, w in enumerate(b)] for b in body]  # Jaccard 0.3
    rows = [(100 * k + i, " ".join(t)) for k, group in enumerate((body, near, far)) for i, t in enumerate(group)]
    rows += [(None, "one text here"), (None, "and one more"), (None, "AND one  more"), (3, "a"), (3, "b"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (64, 1):
        got = sorted((str(r.doc_id), str(r.text).lower().split()) for r in simhash.keep_first_similar(df, bucket_limit=limit).collect())
        assert got == sorted((str(i), str(t).lower().split()) for i, t in rows if i not in range(100, 140) and t != "AND one  more")
    assert simhash.keep_first_similar(df.limit(0)).count() == 0


def test_sketches_of_similar_sets_are_alike():
    rng = np.random.default_rng(5)
    for n in (1, 4, 40, 400, 4000):
        for similarity, want in ((0.8, True), (0.3, False)):
            both = int(round(2 * n * similarity / (1 + similarity)))  # two sets of n with this Jaccard, or a little more
            both += both < 2 * n * similarity / (1 + similarity)
            hits = 0
            for _ in range(200):
                h = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
                size, bins = simhash.read_sketches([simhash.sketch(v) for v in (h[:n], h[n - both :])])
                hits += bool(simhash.alike(size[0], bins[0], size[1], bins[1], 0.8))
            assert hits >= 198 if want else n < 40 or hits <= 20


def test_components_of_links_that_no_task_holds_alone(spark, monkeypatch):
    rng = random.Random(6)
    links = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4200)]
    low: dict[int, int] = {}

    def root(x: int) -> int:
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            low[max(a, b)] = min(a, b)
    want = sorted((x, root(x)) for x in low)
    df = spark.createDataFrame(links * 2, "a long, b long")
    for most in (graph.TASK_LINKS, 40):
        monkeypatch.setattr(graph, "TASK_LINKS", most)
        assert sorted(map(tuple, graph.connected_components(df).collect())) == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_dense_group_loses_no_pair(spark, monkeypatch):
    rng = random.Random(8)

    def edited(words, n):
        out = words[:]
        for i in rng.sample(range(2, len(words), 5), n):
            out[i] = f"e{rng.random()}"
        return out

    base = [f"w{i}" for i in range(200)]
    first = [edited(base, 6) for _ in range(120)]  # about 0.5 to each other; their copies about 0.81 to them
    texts = [" ".join(t) for t in [*first, *[edited(t, 4) for t in first]]]
    sets = [{t[i : i + 5] for i in range(196)} for t in map(tuple, (t.split() for t in texts))]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and low[i] != low[j]:
                low = [min(low[i], low[j]) if k in (low[i], low[j]) else k for k in low]
    assert 100 < len(set(low)) < 140
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit, block in ((128, 200_000), (4, 200_000), (4, 5_000)):
        monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
        assert sorted(r.doc_id for r in simhash.keep_first_similar(df, bucket_limit=limit).collect()) == sorted(set(low))


def test_similar_short_texts_lose_no_pair(spark):
    """Of texts of nine words and the same with one word more few bits agree, so that sampled bits alone miss some."""
    rng = random.Random(11)
    first = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9 if k % 2 else 8)) for k in range(600)]
    rows = [(k, t) for k, t in enumerate(first)] + [(1000 + k, f"{t} x{k}") for k, t in enumerate(first)]  # Jaccard 0.83 and 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first_similar(df).collect()) == list(range(600))


def test_texts_of_common_lines_lose_no_pair(spark, monkeypatch):
    """Texts made of lines that most others hold: what is rare decides, and tasks count common lines themselves."""
    rng = random.Random(12)
    lines = [" ".join(f"c{k}w{i}" for i in range(20)) for k in range(12)]
    own = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(30)) for _ in range(150)]
    texts = [" ".join([*lines[: 3 + k % 8], u]) for k, u in enumerate(own)]
    texts += [f"{t} tail words of a copy" for t in texts] + [" ".join(lines[:k]) for k in range(1, 13)]
    rng.shuffle(texts)
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and low[i] != low[j]:
                low = [min(low[i], low[j]) if k in (low[i], low[j]) else k for k in low]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").repartition(5)
    for common, gather in ((64, 1_000_000), (2, 500)):
        monkeypatch.setattr(simhash, "COMMON", common, raising=False)
        monkeypatch.setattr(simhash, "GATHER", gather, raising=False)
        assert sorted(r.doc_id for r in simhash.keep_first_similar(df).collect()) == sorted(set(low))


def test_no_exploded_table_is_broadcast(spark):
    """15 rows of each fingerprint look like one to Spark, and far less than the least size that it broadcasts."""
    fps = spark.range(20_000).selectExpr("xxhash64(id) as fp")
    for limit in (512, 1):
        links = simhash.near_links(fps.limit(20_000 if limit > 1 else 200), 3, limit)
        links.collect()
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [t#" in plan and not re.search(r"BroadcastHashJoin \[t#\d+, key#", plan)
