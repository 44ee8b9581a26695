"""Near-duplicate documents: an n-gram Jaccard join through a MinHash LSH forest.

A document is the set of its shingles of five words (A-Z lower-cased); a text of fewer words, but not none, is one
shingle. Documents with equal sets are one node, by a 64-bit fingerprint. In each of TREES trees a node has a path of LEVELS bytes, one of
a min-hash each. Paths are range-partitioned and sorted by tree, so that nodes with a common prefix lie side by side: the
sorted form of a prefix trie, in which no prefix is a key that one task must hold. One pass over it gives, for every level, links of each node
to the first node of its run of equal prefixes.

The join starts with whole paths and shortens the matched prefix level by level. Nodes linked at a level form groups within which sets
are compared exactly. Each link found tells, by its similarity, how likely the level was to find it; the links found, weighed by the inverse of
that (Horvitz and Thompson's estimate of all there are), give the level's recall. The first level with the target recall is the last one. A level at
which even links at the threshold meet with the target probability needs no further one, whatever was found.

Groups are the components of the links; sets are compared in blocks of at most BLOCK by BLOCK nodes, without a row for
each pair. A block gives each node's number of links and the smallest node that its links reach. The components of those are the classes.

Result: one row for each document with its class (smallest doc_id in it) and the number of other documents with a
similarity of at least the threshold. Defined cases: a null or wordless text is like no other, and its class is its own doc_id;
equal texts are alike; repeated rows are documents of their own; rows of a null doc_id are compared too, and a class of
only such rows has a null class. A very long text is worked on alone, as arrays of its words. An empty table gives an empty result. Only
doc_id and text are read, so further columns cannot clash; `dedup` gives back all columns and joins by names that it takes from none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .components import components
from .shared import buckets, cut, key_of, keyed, mark_of

TREES, LEVELS, TARGET_RECALL = 40, 8, 0.9995
SHINGLE, THRESHOLD = 5, 0.8
BLOCK = 512
_SHINGLES = 0xF1357AEA2E62A9C5

_rng = np.random.default_rng(77)
_MULTIPLY = (_rng.integers(0, 1 << 31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)


def chance(similarity: np.ndarray | float, level: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that two sets share a prefix of `level` min-hashes in some tree."""
    return 1 - (1 - similarity**level) ** trees


def shingles(texts: tk.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, hash), by text."""
    starts, ends, first = texts.words()
    hashes = texts.hashes(starts, ends, lower=True)
    at, h = tk.windows(hashes, first, size, _SHINGLES)
    who = tk.owner(first)[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = tk.span_hashes(tk.prefix_sums(hashes, _SHINGLES), _SHINGLES, first[short], first[short + 1])
        who, h = np.concatenate([who, short]), np.concatenate([h, whole])
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (who[1:] != who[:-1]) | (h[1:] != h[:-1])
    return who[new], h[new]


def paths(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Paths (sets x trees) of sets h[first[k]:first[k+1]], none empty: a byte of each level's min-hash, the first on top."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first) - 1, TREES), np.uint64)
    for t in range(TREES):
        for d in range(LEVELS):
            low = np.minimum.reduceat(x * _MULTIPLY[t * LEVELS + d] + _ADD[t * LEVELS + d], first[:-1])
            byte = (low * np.uint32(0x9E3779B1)) >> np.uint32(24)
            out[:, t] = (out[:, t] << np.uint64(8)) | byte.astype(np.uint64)
    return out


_FACTS = "doc_id long, key long, mark binary, node long, paths array<long>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to their nodes and paths."""
    for batch in batches:
        for part, texts in tk.slices(batch):
            who, h = shingles(texts)
            first = np.searchsorted(who, np.arange(part.num_rows + 1))
            full = np.flatnonzero(np.diff(first))
            node = np.zeros(part.num_rows, np.int64)
            found = np.zeros((0, TREES), np.uint64)
            if len(full):
                sets = np.append(first[full], len(h))
                with np.errstate(over="ignore"):
                    fingerprint = tk.mix(np.add.reduceat(tk.mix(h ^ np.uint64(0x5851F42D4C957F2D)), sets[:-1]) + np.diff(sets).astype(np.uint64))
                node[full] = fingerprint.view(np.int64)
                found = paths(h, sets)
            empty = np.ones(part.num_rows, bool)
            empty[full] = False
            ends = np.concatenate([[0], np.cumsum(~empty)]).astype(np.int32) * TREES
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("key"), part.column("mark"), pa.array(node, mask=empty), lists], names=["doc_id", "key", "mark", "node", "paths"]
            )


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("tree", pa.int32()), ("path", pa.int64())])
_LINKS_SQL = "a long, b long, level int, tree int, path long"


def last_level(threshold: float, target: float) -> int:
    """The longest prefix that even links at the threshold share with the target probability: no shorter one is needed."""
    return max([level for level in range(1, LEVELS + 1) if chance(threshold, level) >= target], default=1)


def _descended(low: int):
    """Sorted paths to links (a, b) of each node and the first of its run, with the longest prefix (of `low` levels at least) that links them so.

    The first and the last path come too, at level 0 with b null: there a run may go on in the partition before or after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(batches, low)

    return run


def _linked(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    def edge(tree: np.ndarray, path: np.ndarray, node: np.ndarray, k: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": node[[k]], "b": pa.nulls(1, pa.int64()), "level": [0], "tree": tree[[k]], "path": path[[k]]}, schema=_LINKS)

    last, leaders, end = None, {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, path, node = (batch.column(c).to_numpy() for c in ("tree", "path", "node"))
        if last is None:
            yield edge(tree, path, node, 0)
            last = (tree[:1] - 1, path[:1], node[:1])
        before_tree, before = np.concatenate([last[0], tree[:-1]]), np.concatenate([last[1], path[:-1]])
        differ = (path ^ before).view(np.uint64)
        at = np.arange(len(node))
        above = None  # leaders one level longer
        for level in range(LEVELS, low - 1, -1):
            new = (tree != before_tree) | (differ >> np.uint64(64 - 8 * level) != 0)
            start = np.maximum.accumulate(np.where(new, at, -1))
            lead = np.where(start >= 0, node[np.maximum(start, 0)], leaders.get(level, node[0]))
            leaders[level] = int(lead[-1])
            live = (lead != node) & (True if above is None else lead != above)
            if live.any():
                n = int(live.sum())
                yield pa.RecordBatch.from_arrays([pa.array(node[live]), pa.array(lead[live]), pa.array(np.full(n, level, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], schema=_LINKS)
            above = lead
        last = (tree[-1:], path[-1:], node[-1:])
        end = (tree, path, node)
    if end is not None:
        yield edge(*end, -1)


def links(sets: DataFrame, low: int = 1) -> DataFrame:
    """(a, b, level): nodes that share a prefix of `level` levels (`low` at least), so that the prefix's nodes hang together."""
    n = buckets(sets.sparkSession)
    every = sets.select("node", F.posexplode("paths").alias("tree", "path"))
    dealt = every.repartitionByRange(n, "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = cut(dealt.mapInArrow(_descended(low), _LINKS_SQL), "near_paths")
    # Two rows for each partition.
    edges = found.where("level = 0").select("tree", "path", F.col("a").alias("node")).distinct().repartition(1).sortWithinPartitions("tree", "path", "node")
    across = edges.mapInArrow(_descended(low), _LINKS_SQL).where("level > 0")
    both = found.where("level > 0").unionByName(across)
    return cut(both.groupBy("a", "b").agg(F.max("level").alias("level")), "near_links")


def compare(sets: list[np.ndarray], weight: np.ndarray, cross: np.ndarray | None, threshold: float, level: int) -> tuple[np.ndarray, ...]:
    """Exact links among some sets: each one's weight of links, the first set that its links lead to, its links' number and that weighed by 1 / chance.

    cross: the side of each set, if only sets of different sides are to be compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((n, min(4096, int(column[-1]) + 1 - a)), np.float32)
        block[row[i:j], column[i:j] - a] = 1
        both += block @ block.T
    near = both.astype(np.float64) * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(near, False)
    if cross is not None:
        near &= cross[:, None] != cross[None, :]
    one, other = np.nonzero(near)
    same = both[one, other].astype(np.float64)
    weighed = 1 / chance(same / np.maximum(size[one] + size[other] - same, 1), level)
    number, expected = near.sum(axis=1), np.bincount(one, weighed, n)
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(near, root[None, :], n).min(axis=1, initial=n))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return near @ weight, root, number, expected
        root = low


_UNIT = ("label", "i", "j")


_VERIFIED = "node long, root long, links long, number long, expected double"


def _verified(threshold: float, level: int):
    out = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("number", pa.int64()), ("expected", pa.float64())])

    def unit(rows: pa.Table) -> pa.RecordBatch | None:
        nodes, at = np.unique(tk.longs(rows.column("node").combine_chunks()), return_index=True)
        if len(nodes) < 2:
            return None
        rows = rows.take(pa.array(at))
        batch = rows.combine_chunks().to_batches()[0]
        sets: list[np.ndarray] = []
        for part, texts in tk.slices(batch):
            who, h = shingles(texts)
            first = np.searchsorted(who, np.arange(part.num_rows + 1))
            sets += [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        side = tk.longs(batch.column("block")) if i != j else None
        links, root, number, expected = compare(sets, tk.longs(batch.column("copies")).astype(np.float64), side, threshold, level)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root]), pa.array(links.astype(np.int64)), pa.array(number.astype(np.int64)), pa.array(expected)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the unit that is not over
        last = None
        for batch in batches:
            ids = np.stack([tk.longs(batch.column(c)) for c in _UNIT])
            cuts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if tuple(ids[:, a].tolist()) != last and held:
                    if (found := unit(pa.Table.from_batches(held))) is not None:
                        yield found
                    held = []
                last = tuple(ids[:, a].tolist())
                held.append(batch.slice(a, b - a))
        if held and (found := unit(pa.Table.from_batches(held))) is not None:
            yield found

    return run


def _compared(rows: DataFrame, sets: DataFrame, candidates: DataFrame, threshold: float, level: int) -> DataFrame:
    """Exact links within the groups that candidates (a, b) form: (node, root, links, number, expected)."""
    groups = components(candidates)
    size = cut(groups.groupBy("label").agg(F.count("*").alias("n")), "near_sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = groups.join(size, "label").join(sets, "node").select(
        "node", "label", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int").alias("block"), F.col("first.key").alias("key"), F.col("first.mark").alias("mark")
    )
    texts = rows.select("key", "mark", "text").join(cut(members, "near_members").hint("merge"), ["key", "mark"]).drop("key", "mark")
    units = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "text"
    )
    dealt = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return cut(dealt.mapInArrow(_verified(threshold, level), _VERIFIED), "near_verified")


def classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, key, mark, class_id, n_links, first): the class and links of each document; first: the class's smallest (key, mark)."""
    rows = keyed(docs)
    facts = cut(rows.mapInArrow(_facts, _FACTS), "near_facts")
    nodes = facts.where("node is not null").groupBy("node")
    first = F.min(F.struct("key", "mark")).alias("first")
    sets = cut(nodes.agg(first, F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("paths").alias("paths")), "near_sets")
    low = last_level(threshold, target)
    met = links(sets.select("node", "paths"), low)
    for level in range(LEVELS, low - 1, -1):
        verified = _compared(rows, sets.drop("paths"), met.where(F.col("level") >= level).select("a", "b"), threshold, level)
        found, expected = verified.agg(F.coalesce(F.sum("number"), F.lit(0)), F.coalesce(F.sum("expected"), F.lit(0.0))).first()
        if found and found / expected >= target:
            break
    return _classed(facts, sets, verified)


def _classed(facts: DataFrame, sets: DataFrame, verified: DataFrame) -> DataFrame:
    near = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))

    labelled = sets.drop("paths").join(found, "node", "left").join(near, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min("first").alias("first"))
    nodes = labelled.select("node", "label", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).join(least, "label")
    nodes = cut(nodes.select("node", "class_id", "n_links", "first"), "near_nodes")
    return facts.drop("paths").join(nodes, "node", "left").select(
        "doc_id",
        "key",
        "mark",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "first",
    )


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of one document of each class: that of smallest doc_id. All columns stay; wordless texts stay."""
    found = classes(docs.select("doc_id", "text"), threshold)
    first = F.coalesce(F.col("first"), F.struct("key", "mark"))
    stay = cut(found.where(F.struct("key", "mark") == first).select("key", "mark", F.col("first").isNull().alias("alone")).distinct(), "near_stay")
    names = [f"c{k}" for k in range(len(docs.columns))]  # given names cannot clash with those of the join
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    joined = rows.join(stay, (key_of(doc_id) == F.col("key")) & (mark_of(doc_id, text) == F.col("mark")))
    alone = F.when(F.col("alone"), F.monotonically_increasing_id())  # equal rows without words are not alike
    return joined.withColumn("row", alone).dropDuplicates(["key", "mark", "row"]).select(*names).toDF(*docs.columns)
