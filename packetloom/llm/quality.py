"""Quality rules: fixed rules on counts, then hashed word and character n-gram logistic regression.

Two heads share the features, one for each label of the labelled rows: quality and toxic. Both are trained with
numpy, in one task, on a bounded sample of labelled documents (SAMPLE rows, those of smallest hash, whatever the size of the table),
calibrated by Platt scaling on a held-out quarter of it, and scored in Arrow batches against fixed thresholds. A
document is kept when no rule fails, the quality probability is at least KEEP_QUALITY, and the toxic probability is
below DROP_TOXIC.

Features of a text: the set of its hashed words (A-Z lower-cased runs of letters, digits and non-ASCII bytes), of their
bigrams and of the n-grams that words begin with, which catch the inflections of a stem; and the shares of its hashed character trigrams.

Defined cases: a null or wordless text has no words, so it fails the rules; a very long text is worked on alone, as arrays of its
words; equal rows are judged alike; label rows
with a null are not used; a document with several label rows counts once for each; without rows of both classes a head gives its
base rate. Empty tables give an empty result. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk

#: Most labelled rows that a classifier is fitted on.
SAMPLE = 6000
#: Bytes of their text that are worked on at once.
SAMPLE_SLICE = 1 << 20
WORD_SLOTS, CHAR_SLOTS = 1 << 18, 1 << 10
WORD_SCALE, CHAR_SCALE = 15.0, 60.0
#: Bytes of the n-grams at the beginnings of words.
HEADS = (4, 5)
#: A word feature has a weight when so many documents of the sample have it.
MIN_DOCS = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PAIR = 0x8EBC6AF09C88C6E3


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of different texts apart."""
    return tk.mix(hashes ^ (owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def counts(texts: tk.Texts) -> dict[str, np.ndarray]:
    """The numbers that the rules use, for each text."""
    starts, ends, first = texts.words()
    n, who = np.diff(first), tk.owner(first)
    sums = texts.sums()
    hashes = tk.span_hashes(sums, tk.BASE_BYTES, starts, ends)
    points = tk.WORD_BYTES[texts.buf] & ((texts.buf & 0xC0) != 0x80)

    # Lines: cut at \n and at the ends of texts; only those with a word count.
    breaks = np.flatnonzero(texts.buf == 10)
    line_starts = np.unique(np.concatenate([texts.bounds[:-1], breaks + 1]))
    line_ends = np.append(line_starts[1:], len(texts.buf))
    ended = np.isin(line_ends - 1, breaks, assume_unique=True)
    line_ends = line_ends - ended
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    a, b = line_starts[worded], line_ends[worded]
    line_owner = np.searchsorted(texts.bounds, a, "right") - 1
    lines = _keyed(tk.span_hashes(sums, tk.BASE_BYTES, a, b), line_owner)
    order = np.argsort(lines)
    again = np.concatenate([[False], lines[order][1:] == lines[order][:-1]]) if len(a) else np.zeros(0, bool)
    dup_lines = np.bincount(line_owner[order][again], minlength=len(n)) if len(a) else np.zeros(len(n), np.int64)

    at, grams = tk.windows(hashes, first, 3)
    keyed = _keyed(grams, who[at])
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[twice + k] = True
    return {
        "n_words": n,
        "word_chars": _per_text(points, texts.bounds),
        "n_symbols": _per_text(_SYMBOLS[texts.buf], texts.bounds),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_text(hit, first),
    }


def code_points(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Characters of some texts, and the texts' bounds among them."""
    first = (texts.buf & 0xC0) != 0x80
    if first.all():
        return texts.buf.astype(np.uint32), texts.bounds
    points = np.frombuffer(texts.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(first)])[texts.bounds]


def features(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word features (text, slot), and every trigram's (text's bounds, slot)."""
    starts, ends, first = texts.spans(tk.ALNUM_BYTES)
    who = tk.owner(first)
    sums = texts.sums(lower=True)
    hashes = [tk.mix(tk.span_hashes(sums, tk.BASE_BYTES, starts, np.minimum(starts + size, ends)) + np.uint64(size)) for size in (*HEADS, 1 << 32)]
    at, pairs = tk.windows(hashes[-1], first, 2, _PAIR)
    both = np.unique(np.concatenate([(w.astype(np.uint64) << np.uint64(18)) | (h >> np.uint64(46)) for w, h in [*((who, h) for h in hashes), (who[at], pairs)]]))
    text, slot = (both >> np.uint64(18)).astype(np.int64), (both & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
    b, bounds = code_points(texts)
    grams = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) if len(b) > 2 else np.zeros(0, np.uint32)
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(22)
    # A trigram belongs to the text that holds all of it.
    low = np.minimum(bounds[:-1], len(grams))
    high = np.clip(bounds[1:] - 2, low, len(grams))
    return text, slot, np.stack([low, high]), grams.astype(np.int64)


def word_scale(text: np.ndarray, n: int) -> np.ndarray:
    """Value of a word feature in each text: less where there are many, so that long texts are judged like short ones."""
    return WORD_SCALE / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k+1]]."""
    out, some = np.zeros(len(bounds) - 1), bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, bounds[:-1][some], dtype=np.float64)
    return out


@dataclass
class Head:
    """One calibrated logistic regression."""

    words: np.ndarray
    chars: np.ndarray
    scale: float
    shift: float

    def raw(self, n: int, text: np.ndarray, slot: np.ndarray, bounds: np.ndarray, grams: np.ndarray) -> np.ndarray:
        out = np.bincount(text, self.words[slot], n) * word_scale(text, n)
        sums = np.concatenate([[0.0], np.cumsum(self.chars[grams], dtype=np.float64)])
        return out + CHAR_SCALE * (sums[bounds[1]] - sums[bounds[0]]) / np.maximum(bounds[1] - bounds[0], 1)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -40, 40)))


def _adam(params: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(params, gradient(), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


@dataclass
class Sample:
    """Features of labelled documents; word features that few of them have are left out.

    Word features are kept twice, in the order of texts and in that of slots, without values: those are of a text or of a slot.
    """

    n: int
    live: np.ndarray
    by_text: np.ndarray
    text_bounds: np.ndarray
    by_slot: np.ndarray
    slot_bounds: np.ndarray
    scale: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Sample:
        n, often, slots, scales, shares = 0, [], [], [], []
        for batch in batches:
            for part, some in tk.slices(batch, limit=SAMPLE_SLICE):
                text, slot, bounds, grams = features(some)
                often.append(np.bincount(text, minlength=part.num_rows))
                slots.append(slot.astype(np.int32))
                scales.append(word_scale(text, part.num_rows))
                for a, b in bounds.T.tolist():
                    shares.append(np.bincount(grams[a:b], minlength=CHAR_SLOTS).astype(np.float32) / max(b - a, 1))
                n += part.num_rows
        total = sum((np.bincount(x, minlength=WORD_SLOTS) for x in slots), np.zeros(WORD_SLOTS, np.int64))
        common = total >= MIN_DOCS
        live = np.flatnonzero(common)
        rank = (np.cumsum(common) - 1).astype(np.int32)
        texts, kept, a = [], [], 0
        while slots:
            slot, k = slots.pop(0), often.pop(0)
            keep = common[slot]
            texts.append(np.repeat(np.arange(a, a + len(k), dtype=np.int32), k)[keep])
            kept.append(rank[slot[keep]])
            a += len(k)
        text, by_text = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (texts, kept))
        del texts, kept
        text_bounds = np.searchsorted(text, np.arange(n + 1, dtype=np.int32))
        by_slot = text[np.argsort(by_text, kind="stable")]
        slot_bounds = np.concatenate([[0], np.cumsum(total[live])])
        return cls(n, live, by_text, text_bounds, by_slot, slot_bounds, np.concatenate([np.zeros(0), *scales]), np.stack(shares) if n else np.zeros((0, CHAR_SLOTS), np.float32))


def fit_head(sample: Sample, label: np.ndarray, held: np.ndarray, steps: int = 300, l2: float = 1e-3) -> Head:
    """Weights from the rows that aren't held out, Platt scaling from those that are."""
    n, live, scale, shares = sample.n, sample.live, sample.scale, sample.shares
    base = float(np.clip(label.mean() if n else 0.5, 0.01, 0.99))
    if n == 0 or label[~held].min(initial=1) == label[~held].max(initial=0):
        return Head(np.zeros(WORD_SLOTS, np.float32), np.zeros(CHAR_SLOTS, np.float32), 0.0, float(np.log(base / (1 - base))))
    # Each word feature is scaled by how much more often one class has it (a naive Bayes log ratio), which mutes the many that tell nothing.
    of_slots = lambda x: sums_between(x[sample.by_slot], sample.slot_bounds)
    ups, downs = of_slots(label * ~held) + 1, of_slots((1 - label) * ~held) + 1
    ratio = np.log((ups / (label[~held].sum() + 2)) / (downs / ((1 - label[~held]).sum() + 2)))
    w, c, bias = np.zeros(len(live)), np.zeros(CHAR_SLOTS, np.float32), np.zeros(1)
    use, m = (~held).astype(float), float((~held).sum())
    raw = lambda: scale * sums_between((w * ratio).astype(np.float32)[sample.by_text], sample.text_bounds) + CHAR_SCALE * (shares @ c) + bias[0]

    def gradient():
        r = (1 / (1 + np.exp(-np.clip(raw(), -40, 40))) - label) * use / m
        return [ratio * of_slots((r * scale).astype(np.float32)) + l2 * w, CHAR_SCALE * (r.astype(np.float32) @ shares) + l2 * c, np.array([r.sum()])]

    _adam([w, c, bias], gradient, steps, 0.05)
    z = raw()
    check = held if held.any() and label[held].min() != label[held].max() else ~held
    a, b = np.ones(1), np.zeros(1)
    up, down = label[check].sum(), (1 - label[check]).sum()
    target = np.where(label[check] == 1, (up + 1) / (up + 2), 1 / (down + 2))  # Platt's targets

    def calibration():
        r = (1 / (1 + np.exp(-np.clip(a[0] * z[check] + b[0], -40, 40))) - target) / len(target)
        return [np.array([(r * z[check]).sum()]), np.array([r.sum()])]

    _adam([a, b], calibration, 500, 0.05)
    words = np.zeros(WORD_SLOTS, np.float32)
    words[live] = w * ratio
    return Head(words, c.astype(np.float32), float(a[0]), float(a[0] * bias[0] + b[0]))


_HEADS = pa.schema([("head", pa.int32()), ("words", pa.binary()), ("chars", pa.binary()), ("scale", pa.float64()), ("shift", pa.float64())])
_HEADS_SQL = "head int, words binary, chars binary, scale double, shift double"


def _fitted(names: tuple[str, ...]):
    """The whole sample to a head for each label column; a part of every fourth row, in the order given, is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts.append(batch.select(["text"]))
            labels.append(np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in names], float).reshape(len(names), -1))
        wanted = np.clip(np.concatenate([np.zeros((len(names), 0)), *labels], axis=1), 0, 1)
        found = Sample.of(texts)
        del texts
        held = np.arange(found.n) % 4 == 3
        for k, label in enumerate(wanted):
            h = fit_head(found, label, held)
            yield pa.RecordBatch.from_pydict({"head": [k], "words": [h.words.tobytes()], "chars": [h.chars.tobytes()], "scale": [h.scale], "shift": [h.shift]}, schema=_HEADS)

    return run


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE) -> list[Head]:
    """A head for each label column, from at most `sample` labelled rows. One task fits them; only weights come to the driver."""
    usable = labels.where(" and ".join(f"{c} is not null" for c in ("doc_id", *names))).select(F.col("doc_id").alias("__id"), *names)
    chosen = usable.orderBy(F.xxhash64("__id"), "__id", *names).limit(sample)  # a documented bound, so it may be sent to every task
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *names)
    table = rows.orderBy(F.xxhash64("__id"), "__id", F.xxhash64("text"), *names).limit(sample).coalesce(1)
    heads = {r["head"]: r for r in table.select("text", *names).mapInArrow(_fitted(names), _HEADS_SQL).collect()}  # of fixed size
    read = lambda data: np.frombuffer(data, np.float32)
    if not heads:  # an empty table may have no partition
        nothing = Sample.of([])
        return [fit_head(nothing, np.zeros(0), np.zeros(0, bool)) for _ in names]
    return [Head(read(heads[k].words), read(heads[k].chars), heads[k].scale, heads[k].shift) for k in range(len(names))]


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double, toxic_probability double"


def verdicts(heads: list[Head], texts: tk.Texts) -> dict[str, np.ndarray]:
    """Counts, rules, probabilities and verdict for some texts."""
    found = {k: v.astype(np.int64) for k, v in counts(texts).items()}
    n, given = len(texts.bounds) - 1, features(texts)
    good, bad = (h.probability(h.raw(n, *given)) for h in heads)
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
    kept = ~failed & (good >= KEEP_QUALITY) & (bad < DROP_TOXIC)
    return found | {"base_failed": failed, "kept": kept, "quality_probability": good, "toxic_probability": bad}


def score(docs: DataFrame, heads: list[Head]) -> DataFrame:
    """Counts, rules, probabilities and the verdict for each document (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(heads)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tk.slices(batch):
                found = verdicts(model.value, texts)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), **{k: pa.array(v) for k, v in found.items()}})

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tk.slices(batch):
                yield part.filter(pa.array(verdicts(model.value, texts)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
