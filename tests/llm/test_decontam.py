import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import decontam


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, size=13):
    wanted = []
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        wanted += [("null" if item is None else str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for k, text in rows:
        w, hit, found = words(text), set(), set()
        for item, g in wanted:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((k, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, rows, items, size=13):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = decontam.judge(df, bench, size)
    found = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    return sorted(map(tuple, found), key=str)


ALPHABET = [f"w{k}" for k in range(30)]


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    pick = lambda n: list(rng.choice(ALPHABET, n))
    items = [(k, " ".join(pick(rng.integers(4, 25)))) for k in range(25)]
    rows = []
    for k in range(80):
        w = pick(rng.integers(0, 60))
        if k % 2:
            part = items[rng.integers(0, len(items))][1].split()
            a = rng.integers(0, max(1, len(part) - 5))
            w[rng.integers(0, len(w) + 1) : 0] = part[a : a + rng.integers(4, 25)]
        rows.append((k, ", ".join(w)))
    return rows, items


@pytest.mark.parametrize("size", [13, 5])
def test_matches_brute_force(spark, size):
    rows, items = corpus()
    # The two words have one CRC-32.
    rows += [(None, "plumless " + items[2][1]), (None, "buckeroo"), (200, "plumless"), (200, "buckeroo " + items[2][1])]
    rows += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (103, items[1][1].upper()), (103, items[1][1]), (103, items[1][1]), (104, "w1 " * 8000)]
    items += [(3, "w1 w2 w3 w4"), (3, items[5][1]), (None, "w5 w6 w7 w8 w9 w10 w11 w12"), (7, None), (8, "?!"), (5, items[5][1]), (60, "w1 " * 20)]
    assert run(spark, rows, items, size) == brute(rows, items, size)


def test_items_of_one_word(spark):
    rows, items = [(1, "a b c"), (2, "b"), (3, "c a")], [(1, "a"), (2, "b c"), (10, "a b c")]
    assert run(spark, rows, items) == brute(rows, items)


def test_short_items_leave_the_shingles_of_long_ones_alone(spark):
    rows, items = corpus(4)
    items += [(50, "w1"), (51, "w2 w3"), (52, "absent"), (53, "w4 w5 w6")]
    assert run(spark, rows, items) == brute(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    _, parts = decontam.item_parts(bench, 13)
    assert {(min(r.n, 3), r.g) for r in parts.collect()} == {(1, 1), (2, 2), (3, 3)}
    lengths = {(len(r.shingle.split()), r.g) for r in parts.collect()}
    assert lengths == {(1, 1), (2, 2), (3, 3)}


INTERNAL = ["key", "mark", "pos", "shingle", "row", "item", "words", "candidates", "n", "hits", "c0", "c1", "contaminated", "__parts", "items"]


def test_columns_named_like_internal_ones(spark):
    rows, items = corpus(5)
    rows += [(None, items[0][1]), (None, None)]
    df = spark.createDataFrame([(*r, *INTERNAL) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in INTERNAL))
    bench = spark.createDataFrame([(*r, *INTERNAL) for r in items], "item_id long, text string, " + ", ".join(f"{c} string" for c in INTERNAL))
    want = brute(rows, items)
    found = decontam.judge(df, bench).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(map(tuple, found), key=str) == want
    kept = decontam.keep(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)


def test_large_tables_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    rows, items = corpus(3)
    assert run(spark, rows, items) == brute(rows, items)


def test_empty(spark):
    rows, items = corpus()
    assert run(spark, [], items) == []
    assert run(spark, rows[:5], []) == brute(rows[:5], [])
