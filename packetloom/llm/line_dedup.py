"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

Lines are the \\n-split parts of a text that hold a word. Two lines are near when they are equal, or both have at least
MIN_CHARS characters and an edit distance of at most EDITS. An occurrence of a line is removed when a near line occurs
earlier (smaller doc_id, or the same document and an earlier line); lines are judged on the input, not on what is left.

A line of length l is cut into EDITS + 1 segments. A line within EDITS edits holds one of them whole, near its own place, so
each line probes, for its own length and each shorter one in reach, the substrings that the multi-match-aware bounds
leave. Segments and probes meet by hash in buckets. The lines of a key, and no wider group, are compared with each other: those with
the segment with those that probe for it, in units of at most BLOCK lines a side. A pair is verified in the unit of the first
segment that it shares: by its counts of characters, then by banded bit-parallel edit distance, many pairs at once. A unit gives each
line's number of near lines and the earliest place of them, not a row for each pair.

Defined cases: a null text has no lines; equal rows get equal results; a null doc_id comes before all others; rows with
the same doc_id are one document in the order, so neither is earlier than the other at the same line number, but each has its own
result by its text. A very long text is worked on alone, as an array of its code points. An empty table gives an empty
result. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import buckets, cut, keyed

EDITS, MIN_CHARS = 2, 20
BLOCK = 1024
#: Entries that a task gathers before it sends them on.
CHUNK = 2_000_000
_POINTS = 0xB5297A4D3A2D9FE5


class Lines:
    """Lines of some texts, by code points: line k of them is points[starts[k]:ends[k]]."""

    def __init__(self, texts: tk.Texts):
        raw = texts.buf.tobytes()
        self.points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((texts.buf & 0xC0) != 0x80)])
        bounds = heads[texts.bounds]
        breaks = np.flatnonzero(self.points == 10)
        starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
        starts = starts[starts < len(self.points)]
        ends = np.append(starts[1:], len(self.points)) if len(starts) else starts
        ends = ends - ((ends > starts) & (self.points[ends - 1] == 10)) if len(starts) else ends
        word = ~(((self.points >= 9) & (self.points <= 13)) | (self.points == 32))
        worded = np.concatenate([[0], np.cumsum(word)])
        self.owner = np.searchsorted(bounds, starts, "right") - 1
        first = np.searchsorted(starts, bounds[:-1])
        self.number = np.arange(len(starts)) - first[self.owner] if len(starts) else starts
        keep = np.flatnonzero(worded[ends] > worded[starts])
        self.starts, self.ends, self.owner, self.number = starts[keep], ends[keep], self.owner[keep], self.number[keep]
        self.sums = tk.prefix_sums(tk.mix(self.points.astype(np.uint64)), _POINTS)

    def hashes(self) -> np.ndarray:
        return tk.span_hashes(self.sums, _POINTS, self.starts, self.ends)


def _segment(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of a size; the last ones are longer."""
    parts = edits + 1
    short, longer = size // parts, size % parts
    extra = np.maximum(0, i - (parts - longer))
    return i * short + extra, short + (i >= parts - longer)


def _reach(at: np.ndarray, width: np.ndarray, i: int, shorter: np.ndarray | int, length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place at which a line looks for segment i, which lies `at` in a line that is `shorter` by so much."""
    low = np.maximum(np.maximum(at - i, at + shorter - (edits - i)), 0)
    return low, np.minimum(np.minimum(at + i, at + shorter + (edits - i)), length - width)


def entries(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the segments and probes of lines: (line, key, is a segment, segment's number). Equal keys: number, length and text of a segment."""
    out: list[tuple[np.ndarray, np.ndarray, bool, int]] = []
    parts = edits + 1

    def add(lines: np.ndarray, at: np.ndarray, width: np.ndarray, size: np.ndarray, i: int, own: bool) -> None:
        h = tk.span_hashes(sums, _POINTS, starts[lines] + at, starts[lines] + at + width)
        out.append((lines, tk.mix(h ^ tk.mix(size.astype(np.uint64) * np.uint64(64) + np.uint64(i))), own, i))

    every = np.arange(len(starts))
    for i in range(parts):
        at, width = _segment(length, i, edits)
        add(every, at, width, length, i, True)
    for shorter in range(parts):
        size = length - shorter
        for i in range(parts):
            at, width = _segment(size, i, edits)
            low, high = _reach(at, width, i, shorter, length, edits)
            for step in range(-edits, edits + 1):
                place = at + step
                ok = np.flatnonzero((place >= low) & (place <= high))
                if len(ok):
                    add(ok, place[ok], width[ok], size[ok], i, False)
    lines, keys = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    own, number = (np.repeat([x[k] for x in out], [len(x[0]) for x in out]) for k in (2, 3))
    return lines, keys, own, number


def within(points: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    """Which pairs of lines (starts a, b; lengths la, lb, at least edits and at most edits apart) have an edit distance of at most edits.

    The band of 2 * edits + 1 diagonals lies in the top bits of a word and moves down a row with each column.
    """
    out = np.zeros(len(a), bool)
    order = np.argsort(lb, kind="stable")
    one, top = np.uint64(1), np.uint64(63)
    for at in range(0, len(order), 2048):
        k = order[at : at + 2048]
        n, m = la[k], lb[k]
        up = np.full(len(k), ~np.uint64(0) << np.uint64(63 - edits))
        down = np.zeros(len(k), np.uint64)
        distance = np.full(len(k), edits)
        for j in range(int(m.max(initial=0))):
            live = j < m
            char = points[np.minimum(b[k] + j, len(points) - 1)]
            match = np.zeros(len(k), np.uint64)
            for o in range(-edits, edits + 1):
                i = j + o
                same = (i >= 0) & (i < n) & (points[np.clip(a[k] + i, 0, len(points) - 1)] == char)
                match |= same.astype(np.uint64) << np.uint64(63 - edits + o)
            diagonal = (((match & up) + up) ^ up) | match | down
            right = down | ~(diagonal | up)
            left = diagonal & up
            falls = j < n - edits
            distance += live & falls & ((diagonal >> top) == 0)
            bit = np.clip(62 - (j - (n - edits)), 0, 63).astype(np.uint64)
            flat = live & ~falls
            distance += (flat & ((right >> bit) & one == 1)).astype(int) - (flat & ((left >> bit) & one == 1)).astype(int)
            up, down = left | ~((diagonal >> one) | right), (diagonal >> one) & right
        out[k] = distance <= edits
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the numbers and hashes of its lines."""
    for batch in batches:
        for part, texts in tk.slices(batch):
            lines = Lines(texts)
            first = np.searchsorted(lines.owner, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (lines.number.astype(np.int32), lines.hashes().view(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("key"), part.column("mark"), *lists], names=["doc_id", "key", "mark", "numbers", "lines"])


def _packed(edits: int, min_chars: int, n: int):
    """Segments and probes of the distinct lines of a chunk, packed by bucket and in it by kind: 40 bits of the key and the line's hash."""
    out = pa.schema([("place", pa.int32()), ("data", pa.binary())])
    kinds = 2 * (edits + 1)

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        key, line, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        dealt = ((key & np.uint64(0xFFFFFF)) % np.uint64(n)).astype(np.int64) * kinds + kind
        order = np.argsort(dealt.astype(np.uint16) if n * kinds <= 1 << 16 else dealt, kind="stable")
        sizes = np.bincount(dealt, minlength=n * kinds).reshape(n, kinds)
        ends = np.cumsum(sizes.sum(axis=1))
        for p in np.flatnonzero(sizes.any(axis=1)).tolist():
            at = order[ends[p - 1] if p else 0 : ends[p]]
            short = (key[at] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
            data = sizes[p].astype(np.int64).tobytes() + short.tobytes() + line[at].tobytes()
            yield pa.RecordBatch.from_pydict({"place": [p], "data": [data]}, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, texts in tk.slices(batch):
                lines = Lines(texts)
                length = lines.ends - lines.starts
                h, at = np.unique(lines.hashes(), return_index=True)
                ok = length[at] >= min_chars
                h, at = h[ok], at[ok]
                if not len(h):
                    continue
                who, key, own, number = entries(lines.sums, lines.starts[at], length[at], edits)
                parts.append((key, h[who], number * 2 + own))
                held += len(key)
                if held >= CHUNK:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


#: What a line is in a unit: one with the segment, one that probes for it, or both.
SEGMENT, PROBE = 1, 2


def meetings(key: np.ndarray, line: np.ndarray, own: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries to units of lines that are to be compared: (key, i, j, line, what it is there).

    In a unit are block i of the key's lines with the segment and block j of those that probe for it. Lines with a segment probe for it too.
    """
    starts = lambda *x: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in x], axis=0)]))
    if not len(key):
        return
    order = np.argsort(key)
    key, line, own = key[order], line[order], own[order]
    new = starts(key)
    live = np.logical_or.reduceat(own, new) & (np.minimum.reduceat(line, new) != np.maximum.reduceat(line, new))
    keep = np.repeat(live, np.diff(np.append(new, len(key))))
    key, line, own = key[keep], line[keep], own[keep]
    if not len(key):
        return
    order = np.lexsort((~own, line, key))
    key, line, own = key[order], line[order], own[order]
    once = starts(key, line)
    key, line, own = key[once], line[once], own[once]
    new = starts(key)
    sizes = np.diff(np.append(new, len(key)))
    small = np.repeat(sizes <= block, sizes)
    none = np.zeros(int(small.sum()), np.int64)
    yield key[small], none, none, line[small], PROBE + SEGMENT * own[small]
    for a, size in zip(new[sizes > block].tolist(), sizes[sizes > block].tolist(), strict=True):
        segments = np.flatnonzero(own[a : a + size])
        for i in range(0, len(segments), block):
            for j in range(0, size, block):
                what = np.zeros(size, np.int64)
                what[j : j + block] = PROBE
                what[segments[i : i + block]] += SEGMENT
                at = np.flatnonzero(what)
                yield key[a + at], np.full(len(at), i // block), np.full(len(at), j // block), line[a + at], what[at]


def _met(edits: int, block: int):
    """Buckets to units; the id of a key has its bucket, the number of the segment and 40 bits of the key."""
    kinds = 2 * (edits + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: dict[int, list[bytes]] = {}
        for batch in batches:
            for place, packed in zip(batch.column("place").to_pylist(), batch.column("data").to_pylist(), strict=True):
                data.setdefault(place, []).append(packed)
        for place in sorted(data):
            keys, lines, owns = [], [], []
            for packed in data.pop(place):
                sizes = np.frombuffer(packed, np.int64, kinds)
                n = int(sizes.sum())
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(packed, np.uint8, 5 * n, 8 * kinds).reshape(n, 5)
                kind = np.repeat(np.arange(kinds), sizes)
                keys.append(wide.view(np.int64).reshape(n) + ((place * (edits + 1) + kind // 2) << 40))
                lines.append(np.frombuffer(packed, np.int64, n, 8 * kinds + 5 * n))
                owns.append(kind % 2 == 1)
            for found in meetings(np.concatenate(keys), np.concatenate(lines), np.concatenate(owns), block):
                for a in range(0, len(found[0]), 50_000):
                    key, i, j, line, what = (x[a : a + 50_000] for x in found)
                    number = (key >> 40) % (edits + 1)
                    columns = [key, i.astype(np.int32), j.astype(np.int32), line, what.astype(np.int32), number.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["unit", "i", "j", "node", "what", "number"])

    return run


#: Pairs that are compared at once, and characters told apart by a first comparison.
PAIRS, BINS = 1 << 18, 32


def first_shared(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Number of the first segment of line a that line b, as long or longer, holds in reach; edits + 1 if there is none."""
    out = np.full(len(a), edits + 1)
    for i in range(edits, -1, -1):
        at, width = _segment(length[a], i, edits)
        low, high = _reach(at, width, i, length[b] - length[a], length[b], edits)
        sought = tk.span_hashes(sums, _POINTS, starts[a] + at, starts[a] + at + width)
        for step in range(-edits, edits + 1):
            k = np.flatnonzero((at + step >= low) & (at + step <= high))
            place = starts[b[k]] + at[k] + step
            out[k[tk.span_hashes(sums, _POINTS, place, place + width[k]) == sought[k]]] = i
    return out


def near_in_units(lines: list[str], unit: np.ndarray, node: np.ndarray, what: np.ndarray, number: np.ndarray, edits: int) -> np.ndarray:
    """Pairs of rows (2 x n, indexes) within `edits` edits; rows are lines in units, in ascending order of these; number: the segment of a unit.

    A pair is found in the unit of the first segment that it shares only: one of the shorter line, or if both are as long, of that with the smaller node.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(length) - length
    sums = tk.prefix_sums(tk.mix(points.astype(np.uint64)), _POINTS)
    bins = np.bincount(np.repeat(np.arange(len(lines)) * BINS, length) + points % BINS, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int32)
    segments = np.flatnonzero(what & SEGMENT)
    first = np.searchsorted(unit[segments], unit)
    count = np.where(what & PROBE, np.searchsorted(unit[segments], unit, "right") - first, 0)
    total = np.cumsum(count)
    found, row = [np.zeros((2, 0), np.int64)], 0
    while row < len(lines):
        done = int(total[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        b = np.repeat(np.arange(row, stop), count[row:stop])
        a = segments[np.repeat(first[row:stop] - (total[row:stop] - count[row:stop] - done), count[row:stop]) + np.arange(len(b))]
        longer = length[b] - length[a]
        k = np.flatnonzero((longer > 0) & (longer <= edits) | (longer == 0) & (node[a] < node[b]))
        a, b = a[k], b[k]
        # An edit changes the counts of two characters by one at most.
        k = np.flatnonzero(np.abs(bins[a] - bins[b]).sum(axis=1) <= 2 * edits)
        a, b = a[k], b[k]
        k = np.flatnonzero(first_shared(sums, starts, length, a, b, edits) == number[a])
        a, b = a[k], b[k]
        near = within(points, starts[a], length[a], starts[b], length[b], edits)
        found.append(np.stack([a[near], b[near]]))
        row = stop
    return np.concatenate(found, axis=1)


def near_pairs(lines: list[str], edits: int, block: int | None = None) -> np.ndarray:
    """Pairs of lines (2 x n, indexes) within `edits` edits; equal lines are no pair."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(length) - length
    who, key, own, number = entries(tk.prefix_sums(tk.mix(points.astype(np.uint64)), _POINTS), starts, length, edits)
    met = [np.concatenate(x) for x in zip(*meetings((key >> np.uint64(4)).view(np.int64) * (edits + 1) + number, who, own, block or BLOCK), strict=True)]
    if not met:
        return np.zeros((2, 0), np.int64)
    order = np.lexsort((met[2], met[1], met[0]))
    key, i, j, node, what = (x[order] for x in met)
    unit = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    pairs = node[near_in_units([lines[x] for x in node.tolist()], unit, node, what, key % (edits + 1), edits)]
    pairs.sort(axis=0)
    return pairs


_UNIT = ("unit", "i", "j")
#: Lines that are compared at once; units are not divided.
TOGETHER = 8192


def _compared(rows: pa.RecordBatch, unit: np.ndarray, edits: int) -> pa.RecordBatch:
    """Whole units: for each line with links in its unit their number and the earliest place they lead to."""
    nodes, what, number = (tk.longs(rows.column(c)) for c in ("node", "what", "number"))
    a, b = near_in_units(rows.column("line").to_pylist(), unit, nodes, what, number, edits)
    links = np.bincount(np.concatenate([a, b]), minlength=len(nodes))
    key, number = (tk.longs(rows.column(c)) for c in ("first_key", "first_number"))
    rank = np.empty(len(nodes), np.int64)
    order = np.lexsort((number, key))
    rank[order] = np.arange(len(nodes))
    best = np.full(len(nodes), len(nodes))
    np.minimum.at(best, a, rank[b])
    np.minimum.at(best, b, rank[a])
    hit = np.flatnonzero(links)
    first = order[best[hit]]
    return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(key[first]), pa.array(number[first])], names=["node", "links", "near_key", "near_number"])


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """Compares what is held, but for the last unit, of which more may come."""
            nonlocal held, n
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = np.stack([tk.longs(rows.column(c)) for c in _UNIT])
            unit = np.cumsum(np.concatenate([[False], (ids[:, 1:] != ids[:, :-1]).any(axis=0)]))
            stop = rows.num_rows if last else int(np.searchsorted(unit, unit[-1]))
            if stop:
                yield _compared(rows.slice(0, stop), unit[:stop], edits)
            held = [rows.slice(stop)] if stop < rows.num_rows else []
            n = rows.num_rows - stop

        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                held.append(part)
                n += part.num_rows
                if n >= TOGETHER:
                    yield from whole(False)
        if held:
            yield from whole(True)

    return run


def dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links (near lines of its lines, other than equal ones) and removed_lines (numbers from 0)."""
    rows = keyed(docs)
    n = buckets(docs.sparkSession)
    facts = cut(rows.mapInArrow(_facts, "doc_id long, key long, mark binary, numbers array<int>, lines array<long>"), "line_facts")
    once = facts.dropDuplicates(["key", "mark"])
    seen = once.select("key", "mark", F.explode(F.arrays_zip("numbers", "lines")).alias("l")).select("key", "mark", F.col("l.numbers").alias("number"), F.col("l.lines").alias("node"))
    lines = seen.groupBy("node").agg(F.min(F.struct("key", "number", "mark")).alias("first"))

    packed = rows.select("text").mapInArrow(_packed(edits, min_chars, n), "place int, data binary")
    units = cut(packed.repartitionById(n, "place").mapInArrow(_met(edits, BLOCK), "unit long, i int, j int, node long, what int, number int"), "line_units")
    members = units.select("node").distinct().join(lines, "node").select("node", "first.*")
    wanted = cut(members.groupBy("key", "mark").agg(F.collect_list(F.struct("node", "number")).alias("wanted")), "line_members")  # at most the lines of a document
    texts = rows.select("key", "mark", F.split(F.coalesce("text", F.lit("")), "\n").alias("all")).join(wanted.hint("merge"), ["key", "mark"])
    taken = texts.select("key", F.explode(F.transform("wanted", lambda m: F.struct(m["node"], m["number"].alias("at"), F.get("all", m["number"]).alias("line")))).alias("m"))
    taken = taken.select("m.node", F.col("key").alias("first_key"), F.col("m.at").alias("first_number"), "m.line").dropDuplicates(["node"])  # equal rows give a line twice
    units = units.join(taken.hint("merge"), "node")
    dealt = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    found = cut(dealt.mapInArrow(_verified(edits), "node long, links long, near_key long, near_number long"), "line_links")
    near = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.struct(F.col("near_key").alias("key"), F.col("near_number").cast("int").alias("number"))).alias("near"))

    own = F.struct(F.col("first.key").alias("key"), F.col("first.number").alias("number"))
    places = cut(lines.join(near, "node", "left").select("node", F.least(own, "near").alias("earliest"), F.coalesce("links", F.lit(0)).alias("links")), "line_places")
    judged = seen.join(places, "node").withColumn("late", F.col("earliest") < F.struct("key", "number"))
    result = judged.groupBy("key", "mark").agg(
        F.count("*").alias("n_lines"), F.count_if("late").alias("n_removed"), F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.when(F.col("late"), F.col("number")))).alias("removed_lines")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.select("doc_id", "key", "mark").join(result, ["key", "mark"], "left").select(
        "doc_id", zero("n_lines"), zero("n_removed"), zero("n_links"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines")
    )
