"""A second version of the mix's slots: draws, surplus slots that change hands, and permutations, in plain integers."""

from collections import Counter

import numpy as np

from folioscan.llm import mixing

FULL = (1 << 64) - 1


def plain_permuted(k, n, key):
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = k >> half, k & mask
        for r in range(4):
            y = (right + key + (r * 0x9E3779B97F4A7C15 & FULL)) * 0xBF58476D1CE4E5B9 & FULL
            y ^= y >> 31
            y = y * 0x94D049BB133111EB & FULL
            left, right = right, left ^ (y >> 29 & mask)
        k = left << half | right
        if k < n:
            return k


def plain_slots(quota, blocks, size, seed):
    total = sum(quota)
    drawn = {k: [] for k in range(len(quota))}  # the shards of each source's draws, in order
    for shard in range(-(-total // size)):
        n = np.random.Generator(np.random.PCG64([seed, shard])).multinomial(min(size, total - shard * size), np.array(quota) / total)
        for k, c in enumerate(n.tolist()):
            drawn[k] += [shard] * c
    spare = [s for k in drawn for s in drawn[k][quota[k] :]]
    held = {k: drawn[k][: quota[k]] for k in drawn}
    for k in drawn:  # those that drew too few take the surplus in its order
        while len(held[k]) < quota[k]:
            held[k].append(spare.pop(0))
    assert not spare
    out = []
    for k, shards in held.items():
        for number, shard in enumerate(shards):
            turn = number // blocks[k]
            key = (k * 0xD1B54A32D192ED03 + turn * 0x8CB92BA72F3D8DD7 + seed) * 0x9E3779B97F4A7C15 & FULL
            out.append((shard, k, turn, plain_permuted(number % blocks[k], blocks[k], key)))
    return out


def test_slots_by_plain_integers(spark):
    rng = np.random.default_rng(1)
    rows = []
    for source, n in (("a", 40), ("b", 3), ("c", 11), ("d", 1), (None, 25)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(1, 60))), source) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for size, seed in ((16, 1), (7, 5), (100_000, 2)):
        mix = mixing.Mix(docs, block=4, slots=size, seed=seed)
        want = plain_slots([q for *_, q in mix.table], [b for *_, b, _ in mix.table], size, seed)
        got = Counter((r["shard"], r["k"], r["pass"], r["index"]) for r in mix.slots().collect())
        assert got == Counter(want)
