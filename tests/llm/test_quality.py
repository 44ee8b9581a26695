import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import quality
from packetloom.llm import tokens as tk

TEXTS = [
    None, "", " \t\n ", "one", "a b c a b c", "x\nx\n x\nx", "### $ %&|<>* é", "line\n\nline\n\t\nline two\nline two", "a a a a", "é 日本 x y", "a b c d e a b c", "w " * 9000,
    "l\r\nl\nl\r", "\n\na b c\na b c\n",
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_match_brute_force():
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list("ab \n#é"), rng.integers(0, 60))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = []
    for part, some in tk.slices(batch, limit=200):
        found = quality.counts(some)
        got += list(zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert part.num_rows == len(found["n_words"])
    assert got == [brute(t) for t in texts]


def corpus(seed, n):
    """Documents of 60 to 150 words: good prose, symbol junk (quality 0), and prose with an insult (toxic 1)."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for k in range(n):
        w = [f"{rng.choice(['ka', 'lo', 'mi', 'ru'])}{rng.choice(['ne', 'sa', 'to'])}{rng.integers(0, 60)}" for _ in range(rng.integers(60, 150))]
        kind = ("good", "good", "junk", "toxic")[k % 4]
        if kind == "junk":
            w = [x + "###" for x in w]
        if kind == "toxic":
            for at in rng.integers(0, len(w), 4):
                w[at] = "idiot"
        docs.append((seed * 10_000 + k, " ".join(w)))
        labels.append((seed * 10_000 + k, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1, 600)
    more, truth = corpus(2, 200)
    df = spark.createDataFrame(docs + more, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in quality.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    right = [found[k].kept == bool(q and not t) for k, q, t in truth]
    assert np.mean(right) > 0.95
    good = [found[k].kept for k, q, t in truth if q and not t]
    assert np.mean(good) > 0.97


def test_rules_and_edge_cases(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a b"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_words int, kept boolean").repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:6] for r in quality.judge(df, labels).collect()), key=str)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=str)
    assert not any(r.kept for r in quality.judge(df, labels).collect())


@pytest.mark.parametrize("labelled", [True, False])
def test_empty(spark, labelled):
    labels = spark.createDataFrame([(1, 1, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []


def test_keep_returns_whole_rows(spark):
    docs, labels = corpus(1, 200)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string")
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep(df, label)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(df, label).collect() if r.kept}


def bits(k):
    """A word of nine letters, each of two."""
    return "".join("ab"[k >> i & 1] for i in range(9))


def toxic_accuracy(texts, toxic, n_train):
    """Share of the later texts whose toxic probability is on the right side, after fitting on the earlier ones."""
    batch = pa.RecordBatch.from_pydict({"text": texts})
    label = np.array(toxic, float)
    head = quality.fit_head(quality.Sample.of([batch.slice(0, n_train)]), label[:n_train], np.arange(n_train) % 4 == 3)
    some = tk.texts_of(batch.slice(n_train).column("text"))
    found = head.probability(head.raw(len(texts) - n_train, *quality.features(some)))
    return np.mean((found >= 0.5) == label[n_train:])


def test_phrases_of_ordinary_words_tell():
    """Both classes hold the same words and differ in which of them are neighbours."""
    rng = np.random.default_rng(8)
    texts, toxic = [], [k % 2 for k in range(1000)]
    for bad in toxic:
        pairs = rng.choice(30, 12, replace=False)
        after = pairs if bad else np.roll(pairs, 1)
        texts.append(" ".join(f"{bits(a)} {bits(100 + b)} {bits(200 + rng.integers(0, 300))}" for a, b in zip(pairs, after, strict=True)))
    assert toxic_accuracy(texts, toxic, 750) > 0.95


def test_many_moderately_telling_words():
    """Words of an even number of b's are twice as likely in one class, the others in the other; no n-gram of letters tells."""
    rng = np.random.default_rng(9)
    sides = [[bits(k) for k in range(512) if k.bit_count() % 2 == side] for side in (0, 1)]
    texts, toxic = [], [k % 2 for k in range(1400)]
    for bad in toxic:
        texts.append(" ".join(sides[bad if rng.random() < 2 / 3 else 1 - bad][rng.integers(0, 256)] for _ in range(100)))
    assert toxic_accuracy(texts, toxic, 1000) > 0.9
