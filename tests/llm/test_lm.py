import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from packetloom.llm import lm
from packetloom.llm import tokens as tk


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for (k, x), h in zip(rows, held, strict=True):
        w = tokens(x)
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)
        out.append((k, h, len(w), sum(c[t] > 0 for t in w), n, round(base, 6)))
    return sorted(out, key=str)


def corpus(n=400):
    """Two languages of words, each text in one."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(n):
        lang = ("th", "qu")[k % 2]
        rows.append((k, " ".join(f"{lang}{x}" if rng.random() < 0.8 else f"Xy{x}" for x in rng.zipf(1.3, rng.integers(5, 60)) % 500)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    return lm.score(df).collect()


def test_counts_and_base_match_brute_force(spark):
    rows = corpus(60) + [(100, None), (101, ""), (None, "th1 new"), (102, "a " * 9000), (103, "a b"), (103, "a b"), (104, "A B"), (104, "c")]
    got = run(spark, rows)
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_beats_the_base_on_held_out_texts(spark):
    held = [r for r in run(spark, corpus(2000)) if r.held_out]
    assert len(held) > 100
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.05


def test_texts_of_one_id_that_share_a_checksum(spark):
    rows = [(None, "plumless"), (None, "buckeroo"), (1, "plumless"), (2, "buckeroo buckeroo"), (3, "buckeroo")]
    got = run(spark, rows)
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    scores = {(r.doc_id, round(r.base_score, 6)): round(r.score, 6) for r in got}
    assert len({v for (k, _), v in scores.items() if k is None}) == 2
    plum = {round(r.score, 9) for r in got if r.doc_id == 1} | {round(r.score, 9) for r in got if r.doc_id is None}
    assert len(plum) == 2


def some_table(slots=256):
    rng = np.random.default_rng(1)
    return rng.normal(size=(lm.NODES + slots, lm.BRANCH)).astype(np.float32)


def path_probability(table, t, k, classes):
    """Probability of the classes of token k, with plain loops."""
    contexts, above, p = t.contexts(), 0, 1.0
    for level in range(lm.LEVELS):
        rows = lm.rows_of(contexts[:, [k]], np.array([above]), level, len(table) - lm.NODES)[:, 0]
        z = [sum(float(table[r, j]) for r in rows) for j in range(lm.BRANCH)]
        p *= math.exp(z[classes[level]]) / sum(math.exp(x) for x in z)
        if classes[0] == 0:
            break
        above = above * lm.BRANCH + int(classes[level])
    return p


def test_score_matches_an_independent_scorer(spark):
    rows, table = corpus(40) + [(500, None), (501, "unseen th1 words")], some_table()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    c, cell_of = Counter(), {}
    for k, x in rows:
        t = lm.Tokens(tk.texts_of(pa.array([x], pa.string())))
        words = tokens(x)
        cell_of |= dict(zip(words, t.cells().tolist(), strict=True))
        if not held[k]:
            c.update(words)
    size, kinds = Counter(), Counter()
    for w, n in c.items():
        size[cell_of[w]] += n
        kinds[cell_of[w]] += 1
    want = {}
    for k, x in rows:
        t = lm.Tokens(tk.texts_of(pa.array([x], pa.string())))
        total = 0.0
        for i, w in enumerate(tokens(x)):
            share = 1 if w is None else (c[w] + 1) / (size[cell_of[w]] + kinds[cell_of[w]] + 1)
            total += math.log10(path_probability(table, t, i, t.classes[i]) * share)
        want[k] = total
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(df, table).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_probabilities_of_all_words_sum_to_one():
    """All classes after a context, and in each cell its known words and one share for an unknown one."""
    table, t = some_table(), lm.Tokens(tk.texts_of(pa.array(["one two three"])))
    paths = [(0,) * lm.LEVELS] + [x for x in itertools.product(range(lm.BRANCH), repeat=lm.LEVELS) if x[0]]
    rng = np.random.default_rng(3)
    for k in (0, 2):
        total = 0.0
        for path in paths:
            counts = rng.integers(1, 9, rng.integers(0, 4)) if path[0] else []
            shares = [(x + 1) / (sum(counts) + len(counts) + 1) for x in counts] + [1 / (sum(counts) + len(counts) + 1)]
            total += path_probability(table, t, k, path) * sum(shares)
        assert abs(total - 1) < 1e-6


def test_every_token_moves_every_feature():
    """More than one batch, and rows that several contexts of a batch share."""
    rng = np.random.default_rng(4)
    t = lm.Tokens(tk.texts_of(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 3000, n)) for n in (9000, 700, 0, 8000)])))
    slots = 1 << 12
    steps = lm.Steps(np.zeros((lm.NODES + slots, lm.BRANCH), np.float32), np.zeros(lm.NODES + slots, np.float32))
    steps.learn(t)
    want, above = np.zeros(lm.NODES + slots, np.int64), np.zeros(len(t.hashes), np.int64)
    for level in range(lm.LEVELS):
        want += np.bincount(lm.rows_of(t.contexts(), above, level, slots).reshape(-1), minlength=len(want))
        above = above * lm.BRANCH + t.classes[:, level]
    assert steps.used.tolist() == want.tolist()


def test_context_tells_words_of_one_first_class_apart(spark):
    """Words that begin and end alike, each after its own word: to know that two kinds of words take turns is worth log10(2) a token."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3000):
        pairs = rng.integers(0, 12, 60)
        rows.append((k, " ".join(f"go{x} th{x * 7 % 12}a" for x in pairs)))
    held = [r for r in run(spark, rows) if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + math.log10(2) + 0.05


def test_empty_and_untrained(spark):
    assert run(spark, []) == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = run(spark, [(held, "a b")])
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)
