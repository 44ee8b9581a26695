import numpy as np

from packetloom.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within_matches_dynamic_programming():
    rng = np.random.default_rng(2)
    for edits in (1, 2, 3):
        pairs = []
        for _ in range(300):
            a = [chr(97 + x) for x in rng.integers(0, 3, rng.integers(8, 40))]
            b = list(a)
            for _ in range(rng.integers(0, edits + 3)):
                at = rng.integers(0, len(b))
                match rng.integers(0, 3):
                    case 0:
                        b[at] = "z"
                    case 1:
                        b.insert(at, "y")
                    case _:
                        del b[at]
            if abs(len(a) - len(b)) <= edits:
                pairs.append(("".join(a), "".join(b)))
        points = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32-le"), np.uint32)
        la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
        at = np.cumsum(la + lb) - la - lb
        got = ld.within(points, at, la, at + la, lb, edits)
        assert got.tolist() == [distance(a, b) <= edits for a, b in pairs]


def test_near_pairs_finds_all():
    rng = np.random.default_rng(4)
    lines = []
    for _ in range(12):
        base = [chr(97 + x) for x in rng.integers(0, 26, rng.integers(20, 60))]
        for _ in range(8):
            b = list(base)
            for _ in range(rng.integers(0, 4)):
                b[rng.integers(0, len(b))] = "é"
                if rng.random() < 0.5:
                    del b[rng.integers(0, len(b))]
            lines.append("".join(b))
    for edits in (1, 2, 3):
        got = {tuple(x) for x in ld.near_pairs(lines, edits).T.tolist()}
        assert got == {(i, j) for j in range(len(lines)) for i in range(j) if distance(lines[i], lines[j]) <= edits}


def brute(rows):
    seen = []
    for key, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                seen.append(((key is not None, key or 0, number), line))
    lines = sorted({x for _, x in seen})
    near = {a: {b for b in lines if a != b and min(len(a), len(b)) >= ld.MIN_CHARS and distance(a, b) <= ld.EDITS} for a in lines}
    first = {a: min(p for p, x in seen if x == a) for a in lines}
    out = []
    for key, text in rows:
        removed, links, n = [], 0, 0
        for number, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                n += 1
                links += len(near[line])
                if min(first[x] for x in {line, *near[line]}) < (key is not None, key or 0, number):
                    removed.append(number)
        out.append((key, n, len(removed), links, removed))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int").repartition(3)
    return sorted((tuple(r) for r in ld.dedup(df).collect()), key=str)


def corpus():
    rng = np.random.default_rng(9)
    pool = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(18, 50))) for _ in range(12)] + ["short", "shirt", "", " \t", "naïve café au lait du matin"]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.integers(0, 6)):
            x = list(pool[rng.integers(0, len(pool))])
            for _ in range(rng.integers(0, 3)):
                if x:
                    x[rng.integers(0, len(x))] = "#"
            lines.append("".join(x))
        rows.append((k, "\n".join(lines)))
    return rows + [(100, None), (None, pool[0] + "\n" + pool[0]), (101, "\n\n"), (102, pool[1] * 500), (3, pool[2]), (5, "x"), (5, "x")]


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 4)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_texts_of_one_id_that_share_a_checksum(spark):
    rows = [(5, "plumless\nbuckeroo"), (8, "plumless"), (8, "buckeroo"), (9, "buckeroo"), (None, "plumless"), (None, "buckeroo"), (10, "plumless\nnew")]
    assert run(spark, rows) == brute(rows)


def test_columns_named_like_internal_ones(spark):
    rows = corpus()[:20]
    names = ["key", "mark", "node", "lines", "numbers", "label", "n_removed", "links", "a", "b"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    assert sorted((tuple(r) for r in ld.dedup(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_a_chain_of_shared_segments_is_not_compared_as_one_group(spark, monkeypatch):
    """Lines that only share a segment with their neighbours: what is compared grows with the lines, not with their square."""
    rng = np.random.default_rng(7)
    piece = ["".join(chr(97 + x) for x in rng.integers(0, 26, 8)) for _ in range(300)]
    lines = [piece[(k + 1) // 2] + piece[100 + k // 2] + piece[200 + k] for k in range(80)]
    compared = spark.sparkContext.accumulator(0)

    def counted(edits):
        def run(batches):
            for batch in batches:
                compared.add(batch.num_rows)
            yield from ()

        return run

    monkeypatch.setattr(ld, "BLOCK", 4)
    monkeypatch.setattr(ld, "_verified", counted)
    run(spark, list(enumerate(lines)))
    assert len(lines) <= compared.value <= 4 * len(lines)


def test_blocks_of_one_key_in_memory():
    """Lines of one large key in many units: every pair is found once."""
    rng = np.random.default_rng(8)
    lines = sorted({"the same begin" + "".join(chr(97 + x) for x in rng.integers(0, 3, rng.integers(6, 9))) for _ in range(60)})
    found = [tuple(x) for x in ld.near_pairs(lines, 2, 4).T.tolist()]
    assert sorted(found) == [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2]
