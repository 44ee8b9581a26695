import hashlib
import re

import numpy as np

from packetloom.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, size):
    first, out = {}, []
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    place = lambda k, i: (k is not None, k or 0, i)
    for k, w in words:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, place(k, i)), place(k, i))
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < place(k, i):
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, size):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = sd.dedup(df, size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted(map(tuple, got), key=str)


def test_edge_cases(spark):
    p = "a b c d e f g h"
    rows = [(2, p), (1, "x " + p + " y"), (3, None), (4, ""), (5, " \t\n"), (6, p + "  " + p), (7, "é ü z " * 4), (None, "c d e f"), (8, p), (8, p), (9, "a " * 5000), (10, "a " * 30)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d"), (1, "z a b c d"), (2, "a b c d")]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_texts_of_one_id_that_share_a_checksum(spark):
    tail = " a b c d e f g"
    rows = [(1, "plumless" + tail[:8]), (5, "plumless" + tail), (5, "buckeroo" + tail), (None, "plumless w x y z"), (None, "buckeroo w x y z"), (9, "buckeroo w x y z")]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_columns_named_like_internal_ones(spark):
    names = ["key", "mark", "place", "data", "kind", "n_removed", "removed"]
    rows = [(2, "a b c d"), (1, "a b c d"), (None, None)]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = sd.dedup(df, 4).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_empty(spark):
    assert run(spark, [], 4) == []


def test_random(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(k), " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for k in rng.permutation(150)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_pack_round_trip():
    h = np.arange(6, dtype=np.uint64)
    key, mark, pos = np.array([-5, -5, 1, 1, 1, 9]), np.array([1, 1, 2, 2, 3, 4]), np.array([0, 70000, 5, 6, 2, 1 << 30])
    got = sd._unpack(sd._pack(h, key, mark, pos))
    for a, b in zip(got, (h, key, mark, pos), strict=True):
        assert (a == b).all()
