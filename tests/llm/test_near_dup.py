import re

import numpy as np

from packetloom.llm import components, near_dup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and bool(a) and bool(b) and len(a & b) >= threshold * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in range(n) if near[i][j])])
            changed |= low != root[i]
            root[i] = low
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((k, min(ids) if ids else None, sum(near[i])))
    return sorted(out, key=str)


def corpus(seed=0, n=120):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(n // 6):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(30, 200))]
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = f"x{rng.integers(0, 1000)}"
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, class_id int").repartition(3)
    return sorted((tuple(r) for r in near_dup.classes(df).select("doc_id", "class_id", "n_links").collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "  "), (1003, "a b"), (1004, "A  B"), (None, "a b"), (1005, "a b"), (1005, "a b"), (1006, "long " * 20000)]
    assert run(spark, rows) == brute(rows)


#: These two words, and texts that end alike after them, have one CRC-32.
CLASH = ("plumless", "buckeroo")


def test_texts_of_one_id_that_share_a_checksum(spark):
    rows = [(None, CLASH[0]), (None, CLASH[1]), (7, CLASH[0]), (7, CLASH[1]), (8, CLASH[1])]
    assert run(spark, rows) == brute(rows)
    names = ["key", "mark", "row", "alone", "first", "node", "c0", "paths"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = near_dup.dedup(df)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == set(CLASH) and kept.count() == 2


def test_the_prefix_is_shortened_until_the_recall_is_met(spark, monkeypatch):
    seen = []
    compared = near_dup._compared
    monkeypatch.setattr(near_dup, "_compared", lambda *a: seen.append(a[-1]) or compared(*a))
    far = corpus(11, 90)  # copies with up to three changes, many of them near the threshold
    near = [(2000 + k, " ".join([*(f"v{x}" for x in range(300)), f"z{k}"])) for k in range(6)]
    for rows, target, levels in ((near, 0.9995, [8]), (far, 0.999999, [8, 7, 6, 5])):
        seen.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in near_dup.classes(df, target=target).select("doc_id", "class_id", "n_links").collect()), key=str)
        assert got == brute(rows) and seen == levels[: len(seen)] and (len(seen) > 1) == (rows is far)


def test_recall_of_the_first_level(spark):
    """Against brute force: links between texts at 0.8 to 0.9, found by whole paths alone."""
    rng = np.random.default_rng(2)
    assert near_dup.chance(0.8, near_dup.LEVELS) > 0.999
    sets = [np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64)) for _ in range(300)]
    other = [np.concatenate([s[:-12], rng.integers(0, 1 << 63, 12).astype(np.uint64)]) for s in sets]
    both = [*sets, *other]
    p = near_dup.paths(np.concatenate(both), np.concatenate([[0], np.cumsum([len(s) for s in both])]))
    met = (p[:300] == p[300:]).any(axis=1).mean()
    assert met > 0.98


def test_runs_that_cross_partitions(spark):
    """Every node of a prefix hangs together, wherever the sorted paths are cut."""
    rng = np.random.default_rng(4)
    nodes = [(int(k), [int(x) for x in rng.integers(0, 3, near_dup.TREES)]) for k in rng.permutation(60)]
    met = near_dup.links(spark.createDataFrame(nodes, "node long, paths array<long>")).where(f"level >= {near_dup.LEVELS}")
    label = {r.node: r.label for r in components.components(met.select("a", "b")).collect()}
    assert len(label) == 60 and len(set(label.values())) == 1


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = corpus(3, 60)
    base = [f"w{x}" for x in range(100)]
    rows += [(500 + k, " ".join([*base[:50], f"y{k}", *base[50:]])) for k in range(14)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_dedup_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (4, None), (5, "q r s t u v"), (4, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string")
    got = near_dup.dedup(df)
    assert got.columns == ["doc_id", "text", "mark"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 4, 5]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
