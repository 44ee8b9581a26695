"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each task hashes all windows of its documents and settles what it can alone: only the earliest place of a hash
among its documents can be the earliest of all. These earliest places, one for each hash and chunk of documents, are
dealt to buckets by a second, independent hash; each bucket finds hashes with an earlier place elsewhere. Repeated
windows return to their documents, where they merge into maximal intervals of removed words.

The two hashes together have 64 bits and those of the bucket's number. What moves is packed into arrays by bucket,
about ten bytes for each window, and one frequent window is at most one entry for each chunk. A repeated window returns
with its hash: a document takes it only where its own window has that hash, so that texts of one doc_id that happen to share
a checksum (by which they are dealt) stay apart.

Defined cases: a null text has no words; a text of fewer words than a window keeps them all; a very long text is worked on
alone, as arrays of its words; a null doc_id comes before all others; rows with the same doc_id are one document in the order, so neither is earlier than the other at
the same start; equal rows get equal results. An empty table gives an empty result. Only doc_id and text are read, so
further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import buckets, key_of

#: Windows that a task gathers before it sends them on.
CHUNK = 1_000_000
#: Packed windows for a bucket, and packed starts for documents.
WINDOWS, STARTS = 0, 1
_FOUND = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("data", pa.binary())])
_FOUND_SQL = "kind int, place int, data binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: high ones are zero and compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def _pack(h: np.ndarray, key: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries in the order of documents and starts."""
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]))
    counts = np.diff(np.append(new, len(key))).astype(np.uint32)
    step = np.diff(pos, prepend=0)
    step[new] = pos[new]
    return b"".join(
        (np.array([len(h), len(new)], np.int64).tobytes(), h.tobytes(), _planes(step.astype(np.uint32)), _planes(key[new]), _planes(mark[new].astype(np.uint32)), _planes(counts))
    )


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    at, out = 16, []
    for kind, k in ((np.uint64, n), (np.uint32, n), (np.int64, m), (np.uint32, m), (np.uint32, m)):
        size = np.dtype(kind).itemsize * k
        out.append(np.frombuffer(data, kind, k, at) if kind is np.uint64 else _unplanes(data[at : at + size], kind, k))
        at += size
    h, step, key, mark, counts = out
    new = np.cumsum(counts) - counts
    total = np.cumsum(step, dtype=np.int64)
    base = np.repeat(total[new] - step[new], counts) if m else total
    return h, np.repeat(key, counts), np.repeat(mark.astype(np.int64), counts), total - base


def _later(h: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Marks the entries whose hash has an earlier (key, pos) among the entries."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at = order[several]
    at = at[np.lexsort((pos[at], key[at], h[at]))]
    if len(at):
        new = np.concatenate([[True], h[at][1:] != h[at][:-1]])
        least = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        out[at] = (key[at] != key[least]) | (pos[at] != pos[least])
    return out


def _to_documents(kind: int, n: int, h: np.ndarray, key: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Starts packed by the place (of n) where their documents will be."""
    place = (key ^ mark) % n
    order = np.lexsort((pos, mark, key, place))
    ends = np.cumsum(np.bincount(place, minlength=n))
    for p in np.unique(place).tolist():
        at = order[ends[p - 1] if p else 0 : ends[p]]
        data = _pack(h[at], key[at], mark[at], pos[at])
        yield pa.RecordBatch.from_pydict({"kind": [kind], "place": [p], "data": [data]}, schema=_FOUND)


def _settled(size: int, n_buckets: int):
    """Batches of documents to packed windows, and packed starts that are later than another of the chunk."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        h, lane, key, mark, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, mark, key))
        h, lane, key, mark, pos = h[order], lane[order], key[order], mark[order], pos[order]
        late = _later(h, key, pos)
        yield from _to_documents(STARTS, n_buckets, h[late], key[late], mark[late], pos[late])
        first = np.flatnonzero(~late)
        bucket = lane[first]
        order = first[np.argsort(bucket, kind="stable")]
        sizes = np.bincount(bucket, minlength=n_buckets)
        ends = np.cumsum(sizes)
        for b in np.flatnonzero(sizes):
            at = order[ends[b] - sizes[b] : ends[b]]
            data = _pack(h[at], key[at], mark[at], pos[at])
            yield pa.RecordBatch.from_pydict({"kind": [WINDOWS], "place": [b], "data": [data]}, schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for part, texts in tk.slices(batch):
                starts, ends, first = texts.words()
                hashes = texts.hashes(starts, ends)
                at, h = tk.windows(hashes, first, size)
                if not len(at):
                    continue
                _, other = tk.windows(hashes, first, size, tk.BASE_WORDS_2)
                doc = tk.owner(first)[at]
                lane = (other % np.uint64(n_buckets)).astype(np.int32)
                parts.append((h, lane, tk.longs(part.column("key"))[doc], tk.longs(part.column("mark"))[doc], (at - first[doc]).astype(np.int64)))
                n += len(at)
                if n >= CHUNK:
                    yield from flush(parts)
                    parts, n = [], 0
        if parts:
            yield from flush(parts)

    return run


def _resolved(n_buckets: int):
    """Packed windows of a bucket to the starts that are later than another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list] = {}
        for batch in batches:
            for bucket, data in zip(batch.column("place").to_pylist(), batch.column("data").to_pylist(), strict=True):
                packed.setdefault(bucket, []).append(data)
        for bucket in sorted(packed):
            h, key, mark, pos = (np.concatenate(x) for x in zip(*map(_unpack, packed.pop(bucket)), strict=True))
            late = _later(h, key, pos)
            yield from _to_documents(STARTS, n_buckets, h[late], key[late], mark[late], pos[late])

    return run


def _both(size: int, n: int):
    """The two steps after the windows are dealt: starts pass, windows are resolved."""
    resolve = _resolved(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def own() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mine = pa.array(tk.longs(batch.column("kind")) == WINDOWS)
                passed.append(batch.filter(pa.compute.invert(mine)))
                yield batch.filter(mine)

        yield from resolve(own())
        yield from passed

    return run


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """Packed starts of windows that also start earlier: (place, data), each for the documents of one place."""
    n = buckets(docs.sparkSession)
    found = docs.mapInArrow(_settled(size, n), _FOUND_SQL)
    return found.repartitionById(n, "place").mapInArrow(_both(size, n), _FOUND_SQL).select("place", "data")


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mark): the mark only deals out the rows of one key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", key_of(F.col("doc_id")).alias("key"), F.crc32(text).cast("long").alias("mark"))


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Marks the words within windows of `size` at the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + size, n), 1)
    return np.cumsum(edge[:n]) > 0


def _starts_of(packed: list[bytes], size: int):
    """Finds the starts, and the hashes there, for (key, mark) among packed ones."""
    parts = [_unpack(x) for x in packed]
    h, key, mark, pos = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    order = np.lexsort((mark, key))
    h, key, mark, pos = h[order], key[order], mark[order], pos[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])) if len(key) else np.zeros(0, np.int64)
    stop = np.append(new[1:], len(key))[: len(new)]
    at = dict(zip(zip(key[new].tolist(), mark[new].tolist(), strict=True), zip(new.tolist(), stop.tolist(), strict=True), strict=True))

    def find(k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = at.get((k, m), (0, 0))
        return pos[a:b], h[a:b]

    return find


def _own(texts: pa.Array, found: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[np.ndarray]:
    """For each text, of the starts found for it those where its window has the hash found."""
    part = tk.texts_of(texts)
    starts, ends, first = part.words()
    _, hashes = tk.windows(part.hashes(starts, ends), first, size)
    n = np.maximum(np.diff(first) - size + 1, 0)
    out = []
    for (pos, h), k, a in zip(found, n.tolist(), (np.cumsum(n) - n).tolist(), strict=True):
        pos, h = pos[pos < k], h[pos < k]
        out.append(pos[hashes[a + pos] == h])
    return out


def _kept(size: int):
    """Packed starts come first in a partition, then its documents."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        find = None
        for batch in batches:
            here = batch.column("data").is_valid()
            packed += batch.filter(here).column("data").to_pylist()
            batch = batch.filter(pa.compute.invert(here))
            if batch.num_rows and find is None:
                find, packed = _starts_of(packed, size), []
            for part, texts in tk.slices(batch):
                starts, ends, first = texts.words()
                n = np.diff(first)
                gone = np.zeros(len(starts), bool)
                spans: list[list[list[int]]] = []
                found = [find(*x) for x in zip(part.column("key").to_pylist(), part.column("mark").to_pylist(), strict=True)]
                some = [k for k, (pos, _) in enumerate(found) if len(pos)]
                own = dict(zip(some, _own(part.column("text").take(pa.array(some, pa.int64())), [found[k] for k in some], size), strict=True)) if some else {}
                for k in range(part.num_rows):
                    at = own.get(k, ())
                    if len(at):
                        gone[first[k] : first[k + 1]] = hit = covered(int(n[k]), at, size)
                        spans.append(np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2).tolist())
                    else:
                        spans.append([])
                keep = np.flatnonzero(~gone)
                s, e = starts[keep], ends[keep]
                width = e - s + 1
                to = np.cumsum(width) - width
                total = int(width.sum())
                flat = np.arange(total) + np.repeat(s - to, width)
                data = texts.buf[np.minimum(flat, max(len(texts.buf) - 1, 0))] if total else np.zeros(0, np.uint8)
                data[to + width - 1] = 32
                bounds = np.append(to, total)[np.searchsorted(keep, first)]
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                removed = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(removed[first[1:]] - removed[first[:-1]]), pa.array(digests, pa.string()), pa.array(spans, out.field("removed").type)],
                    schema=out,
                )

    return run


def dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """For each document what is left: doc_id, n_words, n_removed, kept_sha256 and the removed intervals of words."""
    rows = _dealt(docs)
    n = buckets(docs.sparkSession)
    starts = repeated_windows(rows, size)
    place = F.pmod(F.col("key").bitwiseXOR(F.col("mark")), F.lit(n)).cast("int").alias("place")
    both = starts.unionByName(rows.select(place, "doc_id", "text", "key", "mark"), allowMissingColumns=True)
    dealt = both.repartitionById(n, "place").sortWithinPartitions(F.col("data").isNull())
    return dealt.select("doc_id", "text", "key", "mark", "data").mapInArrow(_kept(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")
