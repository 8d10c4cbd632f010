import random
import re
from collections import defaultdict

from pyspark.sql import functions as F
from rollcheck.llm import mixing


def size(t):
    return len(re.findall("[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        w = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not full:
            out.update({s: left * weight[s] / w for s in free})
            break
        out.update({s: most * sizes[s] for s in full})
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def made(seed=1, n=900):
    rng = random.Random(seed)
    names = ["b", "a", "zé", "", None, "c", "hot"]
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 60, 300]))), rng.choice(names + ["hot"] * 5)) for i in range(n)]
    return rows + [(3, None, "a"), (None, "x y", "a"), (5, "same row", "c"), (5, "same row", "c"), (6, "word " * 50_000, "b"), (7, "", "empty")]


def test_targets_and_taken(spark):
    rows = made()
    df = spark.createDataFrame([(d, t, s, 0) for d, t, s in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix_documents(df).collect()
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(d), size(t), str(s)) for d, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 + 0.002 * want[s]
    again = mixing.mix_documents(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 7, 50, 1000, 1601):
        df = mixing.permuted(spark.range(n), "id", F.lit(n).cast("long"), F.lit(9), "p")
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_slots_blocks_and_texts(spark):
    rows = made(2, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(df, block_words=16, shard_slots=64)
    slots = mix.slots.collect()
    per = defaultdict(int)
    for s in slots:
        per[(s.place, s.block)] += 1
    assert max(per.values()) <= 2 and len({s.slot for s in slots}) == len(slots)
    known = {r.place: r for r in mix.sources.collect()}
    for p, r in known.items():
        assert sum(s.place == p for s in slots) == r.slots
        if r.slots >= r.blocks:
            assert len({s.block for s in slots if s.place == p}) == r.blocks
    filled = defaultdict(int)
    for r in mix.rows().collect():
        filled[(r.slot, r.place, r.block)] += r.words
    assert all(n == 16 or b == known[p].blocks - 1 for (_, p, b), n in filled.items())
    took = mix.texts_taken().collect()
    assert sum(size(r.text) for r in took) == sum(filled.values())
