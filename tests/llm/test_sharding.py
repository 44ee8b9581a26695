import math
import zlib
from collections import Counter

import pytest
import xxhash

from packetloom.llm import sharding

SCHEMA = "doc_id long, text string, slot string"


def hashed(*parts):
    """Spark's xxhash64 of longs and ints: each value's hash seeds the next; null keeps the seed."""
    seed = 42
    for value, size in parts:
        if value is not None:
            seed = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed)
    return seed


def winner(key, weights, seed=17):
    bids = []
    for j, w in enumerate(weights):
        u = ((hashed((key, 8), (seed, 4), (j, 4)) >> 11) + 0.5) / 2**53
        bids.append((w / -math.log(u), j))
    return max(bids)[1]


def brute(rows, weights, grown):
    out = []
    for key, text in rows:
        data = (text or "").encode()
        spread = hashed((key, 8), (17, 4), (zlib.crc32(data), 8))
        signed = spread - (1 << 64) if spread >> 63 else spread
        out.append([key, len(data) + 8, zlib.crc32(data), "key", winner(key, weights), (spread >> 54, signed), winner(key, grown)])
    order = {}
    for r in sorted(out, key=lambda r: (r[4], r[5][0], r[5][1], r[0] is not None, r[0] or 0, r[2], r[1])):
        r[5], order[r[4]] = order.get(r[4], 0), order.get(r[4], 0) + 1
    return sorted(map(tuple, out), key=str)


def run(spark, rows, weights, grown):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, sharding.assign(df, weights, grown).collect()), key=str)


def test_matches_brute_force(spark):
    rows = [(k, f"text {k}" * (k % 5)) for k in range(300)] + [(7, "other"), (8, "same"), (8, "same"), (None, None), (None, "é"), (900, "long " * 50000)]
    assert run(spark, rows, [1.0] * 5, [1.0] * 6) == brute(rows, [1.0] * 5, [1.0] * 6)


def test_growth_moves_rows_only_into_the_new_shard_and_slots_are_gapless(spark):
    got = run(spark, [(k, "") for k in range(2000)], [1.0] * 8, [1.0] * 9)
    moved = [r for r in got if r[4] != r[6]]
    assert all(r[6] == 8 for r in moved) and 150 < len(moved) < 300
    for shard, n in Counter(r[4] for r in got).items():
        assert sorted(r[5] for r in got if r[4] == shard) == list(range(n))


def test_rows_without_a_key_are_numbered_in_many_groups(spark):
    rows = [(None, f"text {k}") for k in range(500)]
    got = run(spark, rows, [1.0] * 3, [1.0] * 4)
    assert got == brute(rows, [1.0] * 3, [1.0] * 4) and sorted(r[5] for r in got) == list(range(500))
    spread = {hashed((None, 8), (17, 4), (zlib.crc32(t.encode()), 8)) >> 54 for _, t in rows}
    assert len(spread) > 300


def test_weights(spark):
    got = Counter(r[4] for r in run(spark, [(k, "") for k in range(4000)], [1.0, 3.0, 0.0], [1.0]))
    assert got[2] == 0 and 2.5 < got[1] / got[0] < 3.5
    for bad in ([], [0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            sharding.rendezvous(None, bad)


def test_empty(spark):
    assert run(spark, [], [1.0], [1.0]) == []
