"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

A word's place is a path of LEVELS classes, each of BRANCH, and the word itself among those of the last class, its cell. The first class
is a hash of the word's first characters, the second of its last ones, the others of all of it, so related words share
what is learnt and new words have a place too. The probability of a word, given the words before it, is the product of the softmax of each class
within the one above, and the share of the word in its cell. A class softmax adds rows of a hashed table: one for each feature of the
context (the last word, the last two, the word before the last as a skip) together with the classes above, and one of
the classes above alone. In a cell the softmax has one weight for each word, whose optimum is known: the smoothed
share of its counted tokens. The end of a text is the first class of the first level and alone in it.

Training takes PASSES passes over all training documents. In each, every task takes gradient steps over its own documents from the
shared table, at every token for every feature, and Spark averages the tasks' moves of each row, weighed by how often the row was used.

The table has SLOTS rows for contexts at any input size (a parameter), as it is what the driver holds and every task reads. Counts of words,
which grow with the corpus, stay distributed. A task gathers documents into chunks; of each chunk the distinct words go to buckets by
cell, once for each chunk however frequent they are; a bucket counts them and answers every chunk; the chunk sums for its documents. What
a chunk needs for that is written, not computed again, so that a lost executor cannot mix two versions of it.

Defined cases: null is an empty text, whose only token is its end; a null doc_id counts as the text ''; rows with the same
doc_id are in or out of training together; repeated rows are scored alike and each counts; every row keeps its own place, so none is taken
for another. A very long text is worked on alone, as arrays of its words. An empty table gives an empty result; without training documents every word is
unknown. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .shared import buckets, cut
from .substring_dedup import _planes, _unplanes

FOLDS, HELD_OUT = 7, 2
LEVELS, BRANCH, SLOTS, PASSES = 3, 8, 1 << 17, 2
CONTEXTS = 3
#: Rows for the classes above alone: one for each inner class of the tree.
NODES = sum(BRANCH**k for k in range(LEVELS))
CELLS = BRANCH**LEVELS
BATCH, RATE = 8192, 0.2
#: Tokens of a chunk, and of a block of its documents.
CHUNK, BLOCK = 1_500_000, 250_000
#: Rows of the table that move together.
BLOCK_ROWS = 1024
#: Bytes of text worked on at once.
SLICE = 1 << 18
U = np.uint64
_rng = np.random.default_rng(5)
#: Classes of the first two and the last two bytes of a word.
_HEADS, _TAILS = _rng.integers(0, BRANCH - 1, 1 << 17), _rng.integers(0, BRANCH, 1 << 17)
_LEVEL = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0xA0761D6478BD642F)]


class Tokens:
    """Tokens of some texts, ends included: hashes (0: an end), classes (tokens x LEVELS), first token of each text."""

    def __init__(self, texts: tk.Texts):
        starts, ends, first = texts.words()
        sums = texts.sums(lower=True)
        n = len(first) - 1
        self.words = np.arange(len(starts)) + tk.owner(first)
        self.first = first + np.arange(n + 1)
        whole = tk.span_hashes(sums, tk.BASE_BYTES, starts, ends) | U(1)
        self.hashes = np.zeros(len(starts) + n, np.uint64)
        self.hashes[self.words] = whole
        self.classes = np.zeros((len(starts) + n, LEVELS), np.int64)
        low = tk.LOWER_BYTES
        pair = lambda x, y: (low[texts.buf[x]].astype(np.int64) * 256 + low[texts.buf[y]]) * 2 + (ends - starts > 1)
        head, tail = pair(starts, np.minimum(starts + 1, ends - 1)), pair(np.maximum(ends - 2, starts), ends - 1)
        found = [1 + _HEADS[head], _TAILS[tail]] + [((whole >> U(3 * k)) % U(BRANCH)).astype(np.int64) for k in range(1, LEVELS - 1)]
        self.classes[self.words] = np.stack(found, axis=1)

    def cells(self) -> np.ndarray:
        out = np.zeros(len(self.hashes), np.int64)
        for k in range(LEVELS):
            out = out * BRANCH + self.classes[:, k]
        return out

    def contexts(self) -> np.ndarray:
        """Hashes of the features of the context (CONTEXTS x tokens)."""
        n = len(self.hashes)
        place = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))

        def back(k: int) -> np.ndarray:
            out = np.full(n, U(2))
            out[k:] = self.hashes[: n - k] if k < n else self.hashes[:0]
            out[place < k] = U(2)
            return out

        h1, h2 = back(1), back(2)
        return np.stack([tk.mix(h1 * U(3)), tk.mix(h1 * U(0x9E3779B97F4A7C15) + h2 * U(5)), tk.mix(h2 * U(7) + U(11))])


def rows_of(contexts: np.ndarray, above: np.ndarray, level: int, slots: int) -> np.ndarray:
    """Rows of the table for tokens at a level (CONTEXTS + 1 x tokens); above: number of the classes above."""
    out = np.empty((CONTEXTS + 1, contexts.shape[1]), np.int64)
    key = (contexts + (above + 1).astype(np.uint64) * _LEVEL[(level + 1) % 4]) * _LEVEL[level % 4]
    out[:CONTEXTS] = NODES + (key >> U(64 - (slots.bit_length() - 1))).astype(np.int64)
    out[CONTEXTS] = sum(BRANCH**k for k in range(level)) + above
    return out


#: Products with these give sums and factors in all columns, which is faster than to spread one column.
_ONES, _ROW = np.ones((BRANCH, BRANCH), np.float32), np.ones((1, BRANCH), np.float32)
_FIRST = np.zeros(1, np.int64)


def softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the branches (tokens x BRANCH). Weights are small, so the powers need no shift; they are kept from overflow."""
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    z /= z @ _ONES
    return z


class Steps:
    """Gradient steps of one task: from a table and each row's uses in the passes before.

    Every token moves its rows of every kind of context, and those of the classes above.
    """

    def __init__(self, table: np.ndarray, used: np.ndarray):
        self.table = table.copy()
        self.whole = self.table.view(np.dtype(f"V{self.table.itemsize * BRANCH}")).reshape(-1)  # rows as items, which are stored faster
        self.new = not table[:NODES].any()
        self.used = used.copy()
        self.last = np.zeros(len(table), np.int32)

    def _begin(self, t: Tokens) -> None:
        """The classes' own rows begin with the logarithms of their shares in a task's first texts."""
        above, classes, first = np.zeros(len(t.hashes), np.int64), t.classes, 0
        for level in range(LEVELS):
            count = np.bincount(above * BRANCH + classes[:, level], minlength=BRANCH ** (level + 1)).reshape(-1, BRANCH)
            self.table[first : first + len(count)] = np.log((count + 0.5) / (count.sum(axis=1, keepdims=True) + 0.5 * BRANCH))
            above, classes, first = (above * BRANCH + classes[:, level])[classes[:, 0] > 0], classes[classes[:, 0] > 0], first + len(count)

    def learn(self, t: Tokens) -> None:
        if self.new and len(t.hashes):
            self._begin(t)
            self.new = False
        contexts, cells = t.contexts(), t.cells()
        for a in range(0, len(cells), BATCH):
            self._batch(contexts[:, a : a + BATCH], cells[a : a + BATCH])

    def _batch(self, contexts: np.ndarray, cells: np.ndarray) -> None:
        path = cells.astype(np.uint64)
        # Tokens in the order of context and path: those that share a row, at any level, are side by side.
        kinds = []
        for key in [*((c & ~U(CELLS - 1)) | path for c in contexts), path]:
            order = np.argsort(key)
            key = key.take(order)
            kinds.append((order, key[1:] ^ key[:-1]))
        end = np.flatnonzero(cells == 0)
        for level in range(LEVELS):
            above, right = cells // BRANCH ** (LEVELS - level), cells // BRANCH ** (LEVELS - level - 1) % BRANCH
            rows = rows_of(contexts, above, level, len(self.table) - NODES)
            wrong = softmax(self.table, rows)
            wrong.reshape(-1)[np.arange(len(cells)) * BRANCH + right] -= 1
            if level:
                wrong[end] = 0  # an end has no further classes
            shift = U((BRANCH ** (LEVELS - level)).bit_length() - 1)
            for (order, differs), named in zip(kinds, rows, strict=True):
                new = np.concatenate([_FIRST, np.flatnonzero(differs >> shift) + 1])
                move = np.add.reduceat(wrong.take(order, axis=0).view(np.complex64), new, axis=0).view(np.float32)  # pairs at a time
                size = np.empty(len(new), np.float32)
                size[:-1], size[-1] = new[1:] - new[:-1], len(cells) - new[-1]
                self._step(named.take(order.take(new)), size, move)

    def _step(self, at: np.ndarray, size: np.ndarray, move: np.ndarray) -> None:
        """Moves rows against the sums of `size` gradients; of contexts that share a row the last moves it, then the others in turn."""
        while len(at):
            number = np.arange(len(at), dtype=np.int32)
            self.last[at] = number
            # A row's steps shrink with its uses, and those in one batch count as one, so that frequent rows do not leap.
            used = self.used.take(at) + size
            self.used[at] = used
            step = (RATE / np.sqrt(size * used))[:, None] @ _ROW
            step *= move
            self.whole[at] = np.subtract(self.table.take(at, axis=0), step, out=step).view(self.whole.dtype).reshape(-1)
            left = np.flatnonzero(self.last.take(at) != number)
            at, size, move = at[left], size[left], move[left]


def log_classes(table: np.ndarray, t: Tokens) -> np.ndarray:
    """log10 probability of each token's classes."""
    out, every, slots = np.zeros(len(t.hashes)), t.contexts(), len(table) - NODES
    for a in range(0, len(out), BATCH):
        classes = t.classes[a : a + BATCH]
        word, above = np.arange(a, a + len(classes)), np.zeros(len(classes), np.int64)
        for level in range(LEVELS):
            if level == 1:
                live = classes[:, 0] > 0
                word, above, classes = word[live], above[live], classes[live]
            right = classes[:, level]
            p = softmax(table, rows_of(every[:, word], above, level, slots))[np.arange(len(right)), right]
            out[word] += np.log10(np.maximum(p, 1e-30))
            above = above * BRANCH + right
    return out


# --- training --------------------------------------------------------------------------------------------

_PACKED = pa.schema([("place", pa.int32()), ("data", pa.binary())])
_PACKED_SQL = "place int, data binary"


def _joined(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _parted(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _moves(model):
    """A task's training documents to its moves of the table's rows, by block: uses and uses times move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = model.value
        steps = Steps(start, before)
        for batch in batches:
            for _, texts in tk.slices(batch, limit=SLICE):
                steps.learn(Tokens(texts))
        move, used = steps.table - start, steps.used - before
        for b in range(0, len(start), BLOCK_ROWS):
            live = np.flatnonzero(used[b : b + BLOCK_ROWS])
            if len(live):
                n = used[b + live]
                data = _joined(live.astype(np.int32).tobytes(), n.tobytes(), (move[b + live] * n[:, None]).tobytes())
                yield pa.RecordBatch.from_pydict({"place": [b // BLOCK_ROWS], "data": [data]}, schema=_PACKED)

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of moves to the uses and the mean move of each row."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for place, data in zip(batch.column("place").to_pylist(), batch.column("data").to_pylist(), strict=True):
            used, move = sums.setdefault(place, (np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, BRANCH))))
            live, n, m = _parted(data)
            at = np.frombuffer(live, np.int32)
            used[at] += np.frombuffer(n, np.float32)
            move[at] += np.frombuffer(m, np.float32).reshape(-1, BRANCH)
    for place, (used, move) in sums.items():
        mean = (move / np.maximum(used, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"place": [place], "data": [_joined(used.astype(np.float32).tobytes(), mean.tobytes())]}, schema=_PACKED)


def with_fold(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held): whether a document is held out of training."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    return docs.select("doc_id", "text", held.alias("held"))


def train(docs: DataFrame, slots: int = SLOTS, passes: int = PASSES) -> np.ndarray:
    """The table learnt from the documents (doc_id, text) that are not held out; slots: a power of two."""
    rows, spark = with_fold(docs).where(~F.col("held")).select("text"), docs.sparkSession
    table, used = np.zeros((NODES + slots, BRANCH), np.float32), np.zeros(NODES + slots, np.float32)
    blocks = -(-len(table) // BLOCK_ROWS)
    n = min(blocks, buckets(spark))
    for _ in range(passes):
        moves = rows.mapInArrow(_moves(spark.sparkContext.broadcast((table, used))), _PACKED_SQL)
        mean = moves.repartitionById(n, F.pmod("place", F.lit(n)).cast("int")).mapInArrow(_averaged, _PACKED_SQL)
        table, used = table.copy(), used.copy()
        for row in mean.collect():  # the table's blocks, of fixed size together
            a = row.place * BLOCK_ROWS
            uses, moved = (np.frombuffer(x, np.float32) for x in _parted(row.data))
            table[a : a + BLOCK_ROWS] += moved.reshape(-1, BRANCH)[: len(table) - a]
            used[a : a + BLOCK_ROWS] += uses[: len(table) - a]
    return table


# --- counts and scores -----------------------------------------------------------------------------------

#: What a task writes of a chunk: words for a bucket, and blocks of documents; the chunk is (task, number).
WORDS, DOCUMENTS = 0, 1
_CHUNKS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_CHUNKS_SQL = "kind int, chunk long, bucket int, data binary"


@dataclass
class _Chunk:
    """Documents that a task gathers: tokens of texts, and what is known of each document."""

    hashes: list
    cells: list
    docs: list
    n: int = 0

    def add(self, part: pa.RecordBatch, t: Tokens, table: np.ndarray) -> None:
        self.hashes.append(t.hashes)
        self.cells.append(t.cells())
        ids = part.column("doc_id").cast(pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = pa.compute.fill_null(ids, 0).to_numpy()
        held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
        self.docs.append((ids, known, held, np.diff(t.first), np.add.reduceat(log_classes(table, t), t.first[:-1])))
        self.n += len(t.hashes)

    def rows(self, chunk: int, n: int) -> Iterator[pa.RecordBatch]:
        h, cells = np.concatenate(self.hashes), np.concatenate(self.cells)
        ids, known, held, size, score = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        words, at, word = np.unique(h, return_index=True, return_inverse=True)
        trained = np.repeat(~held, size)
        count = np.bincount(word[trained], minlength=len(words))
        place = (tk.mix(cells[at].astype(np.uint64)) % U(n)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place, minlength=n))
        number = np.empty(len(words), np.int64)  # of each word in the order of buckets
        number[order] = np.arange(len(words))
        row = lambda kind, bucket, data: pa.RecordBatch.from_pydict({"kind": [kind], "chunk": [chunk], "bucket": [bucket], "data": [data]}, schema=_CHUNKS)
        for p in np.unique(place).tolist():
            w = order[ends[p - 1] if p else 0 : ends[p]]
            yield row(WORDS, p, _joined(words[w].tobytes(), _planes(cells[at][w].astype(np.uint32)), _planes(count[w].astype(np.uint32))))
        stop = np.cumsum(size)
        a = 0
        while a < len(size):
            done = int(stop[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(stop, done + BLOCK, "right")))
            own = number[word[done : int(stop[b - 1])]]
            pairs, often = np.unique(np.repeat(np.arange(b - a), size[a:b]) * np.int64(len(words)) + own, return_counts=True)
            new = np.searchsorted(pairs, np.arange(b - a + 1) * np.int64(len(words)))
            data = _joined(
                ids[a:b].tobytes(), known[a:b].tobytes(), held[a:b].tobytes(), score[a:b].tobytes(), new.tobytes(), _planes((pairs % len(words)).astype(np.uint32)), _planes(often.astype(np.uint32))
            )
            yield row(DOCUMENTS, -1, data)
            a = b


def _gathered(model, n: int):
    """Documents to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, number = model.value, _Chunk([], [], []), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in tk.slices(batch, limit=SLICE):
                held.add(part, Tokens(texts), table)
                if held.n >= CHUNK:
                    yield from held.rows(number, n)
                    held, number = _Chunk([], [], []), number + 1
        if held.n:
            yield from held.rows(number, n)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a bucket to each chunk's answer (the words' counts, and tokens and words of their cells), and the bucket's totals (chunk -1)."""
    held: dict[int, list] = {}
    for batch in batches:
        for chunk, bucket, data in zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held.setdefault(bucket, []).append((chunk, data))
    for bucket in sorted(held):
        chunks, packed = zip(*held.pop(bucket), strict=True)
        parts = [_parted(data) for data in packed]
        sizes = [len(p[0]) // 8 for p in parts]
        hashes = np.frombuffer(b"".join(p[0] for p in parts), np.uint64)
        cells = np.concatenate([_unplanes(p[1], np.uint32, k) for p, k in zip(parts, sizes, strict=True)]).astype(np.int64)
        counts = np.concatenate([_unplanes(p[2], np.uint32, k) for p, k in zip(parts, sizes, strict=True)])
        words, at, word = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(word, counts, len(words)).astype(np.int64)
        cell = cells[at]
        inside = (np.bincount(cell, total, CELLS) + np.bincount(cell[total > 0], minlength=CELLS)).astype(np.int64)  # tokens and known words
        yield pa.RecordBatch.from_pydict({"kind": [WORDS], "chunk": [-1], "bucket": [bucket], "data": [np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()]}, schema=_CHUNKS)
        a = 0
        for chunk, k in zip(chunks, sizes, strict=True):
            w = word[a : a + k]
            a += k
            yield pa.RecordBatch.from_pydict({"kind": [WORDS], "chunk": [chunk], "bucket": [bucket], "data": [_joined(_planes(total[w]), _planes(inside[cell[w]]), hashes[a - k : a].tobytes())]}, schema=_CHUNKS)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(tokens: int, distinct: int):
    """A chunk's answers, by bucket, then its blocks of documents, to scores."""
    whole = np.log10(tokens + distinct + 1.0)

    def answers(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [_parted(x) for x in packed]
        sizes = [len(p[2]) // 8 for p in parts]
        total, inside = (np.concatenate([_unplanes(p[k], np.int64, n) for p, n in zip(parts, sizes, strict=True)]) for k in (0, 1))
        end = np.frombuffer(b"".join(p[2] for p in parts), np.uint64) == 0
        logs = np.log10(total + 1.0)
        return logs, np.where(end, 0.0, logs - np.log10(inside + 1.0)), total > 0  # an end is alone in its class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        chunk = found = None
        for batch in batches:
            for kind, at, data in zip(batch.column("kind").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if at != chunk:
                    chunk, packed, found = at, [], None
                if kind == WORDS:
                    packed.append(data)
                    continue
                if found is None:
                    found, packed = answers(packed), []
                logs, share, known = found
                ids, valid, held, score, new, word, often = _parted(data)
                new = np.frombuffer(new, np.int64)
                word, often = (_unplanes(x, np.uint32, int(new[-1])).astype(np.int64) for x in (word, often))
                per = lambda x: np.add.reduceat(x * often, new[:-1])  # every document has an end  # noqa: E731, B023
                n = np.add.reduceat(often, new[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(valid, bool)),
                        pa.array(np.frombuffer(held, bool)),
                        pa.array(n),
                        pa.array(per(known[word].astype(np.int64))),
                        pa.array(np.full(len(n), tokens)),
                        pa.array(per(logs[word]) - n * whole),
                        pa.array(np.frombuffer(score) + per(share[word])),
                    ],
                    schema=_OUT,
                )

    return run


def score(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """base_score and score of each document (doc_id, text); without a table, the model is learnt from those that are not held out."""
    spark, n = docs.sparkSession, buckets(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs) if table is None else table)
    chunks = cut(with_fold(docs).mapInArrow(_gathered(model, n), _CHUNKS_SQL), "lm_chunks")
    asked = chunks.where(F.col("kind") == WORDS).repartitionById(n, "bucket")
    answered = cut(asked.mapInArrow(_answered, _CHUNKS_SQL), "lm_answers")
    totals = answered.where("chunk < 0").mapInArrow(_totals, "tokens long, words long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    both = answered.where("chunk >= 0").unionByName(chunks.where(F.col("kind") == DOCUMENTS))
    dealt = both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return dealt.mapInArrow(_scores(*totals), OUT)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"tokens": both[:, 0].copy(), "words": both[:, 1].copy()})
