import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from packetloom.llm import mixing
from packetloom.llm.mixing import Level

LEVELS = (Level("domain", {"web": 3.0, "code": 1.0}, 0.5), Level("lang", {"en": 2.0}), Level("source"))


def share(budget, nodes):
    """Water filling by rounds: nodes are (weight, capacity)."""
    given, left = [0.0] * len(nodes), budget
    live = {i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0}
    while live and left > 1e-9:
        total = sum(nodes[i][0] for i in live)
        full = {i for i in live if given[i] + left * nodes[i][0] / total >= nodes[i][1]}
        if not full:
            for i in live:
                given[i] += left * nodes[i][0] / total
            break
        for i in full:
            left -= nodes[i][1] - given[i]
            given[i] = nodes[i][1]
        # What the others were given before stays theirs.
        live -= full
    return given


def brute(rows, levels, part, epochs, seed="mix-1"):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    leaves = defaultdict(int)
    for r, n in zip(rows, words, strict=True):
        leaves[r[2:]] += n
    weight = lambda level, v: level.weights.get(v, level.other) if v is not None else level.other

    def fill(prefix, budget):
        depth = len(prefix)
        if depth == len(levels):
            return {prefix: math.floor(budget + 1e-6)}
        children = sorted({k[depth] for k in leaves if k[:depth] == prefix}, key=str)
        nodes = [(weight(levels[depth], c), epochs * sum(n for k, n in leaves.items() if k[: depth + 1] == (*prefix, c))) for c in children]
        out = {}
        for c, b in zip(children, share(budget, nodes), strict=True):
            out |= fill((*prefix, c), b)
        return out

    budget = fill((), math.floor(sum(words) * part))
    taken = {}
    for leaf, total in leaves.items():
        whole = min(epochs, budget[leaf] // total) if total else 0
        rest = budget[leaf] - whole * total
        mine = sorted((hashlib.md5(f"{seed}|{whole}|{'null' if r[0] is None else r[0]}".encode()).hexdigest(), n, i) for i, (r, n) in enumerate(zip(rows, words, strict=True)) if r[2:] == leaf)
        run, cut = 0, None
        for p, n, i in mine:
            run += n
            if run > rest:
                cut = (p, n)
                break
        for p, n, i in mine:
            taken[i] = whole + int(rest > 0 and (cut is None or (p, n) < cut))
    return sorted(((r[0], n, taken[i]) for i, (r, n) in enumerate(zip(rows, words, strict=True))), key=str)


def corpus(n=200):
    rng = np.random.default_rng(8)
    out = []
    for k in range(n):
        domain = str(rng.choice(["web", "code", "other"], p=[0.7, 0.2, 0.1]))
        out.append((k, "w " * int(rng.integers(0, 60)), domain, str(rng.choice(["en", "de"])), f"s{rng.integers(0, 3)}"))
    return out


def run(spark, rows, levels=LEVELS, part=0.6, epochs=2):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, domain string, lang string, source string, n_tokens int").repartition(3)
    got = mixing.mix(df, levels, part, epochs)
    return sorted((tuple(r) for r in got.select("doc_id", "__tokens", "__copies").collect()), key=str)


@pytest.mark.parametrize("part, epochs", [(0.1, 1), (0.6, 2), (1.0, 1), (1.7, 2), (5.0, 2)])
def test_matches_brute_force(spark, part, epochs):
    rows = corpus() + [(900, None, "web", "en", "s0"), (901, "a b", None, None, None), (902, "long " * 20000, "code", "de", "s1"), (5, "twice", "web", "en", "s1"), (5, "twice", "web", "en", "s1"), (None, "x y", "web", "en", "s1")]
    assert run(spark, rows, part=part, epochs=epochs) == brute(rows, LEVELS, part, epochs)


def test_shortage_goes_to_siblings_first(spark):
    levels = (Level("domain"), Level("lang"), Level("source"))
    rows = [(k, "w " * 10, "a", "en", "s") for k in range(10)] + [(100, "w " * 10, "a", "de", "s")] + [(200 + k, "w " * 10, "b", "en", "s") for k in range(20)]
    got = {r[0]: r[2] for r in run(spark, rows, levels, part=100 / 310, epochs=1)}
    # 50 tokens each for a and b; German has only 10 of its 25, so English in a gets 40.
    assert sum(got[k] for k in range(10)) == 4 and got[100] == 1 and sum(got[200 + k] for k in range(20)) == 5


def test_zero_weight_takes_nothing(spark):
    levels = (Level("domain", {"web": 0.0}), Level("lang"), Level("source"))
    rows = corpus(60)
    got = run(spark, rows, levels, part=0.9, epochs=1)
    assert got == brute(rows, levels, 0.9, 1)
    web = {r[0] for r in rows if r[2] == "web"}
    assert all(n == 0 for k, _, n in got if k in web)


def test_empty(spark):
    assert run(spark, []) == []
