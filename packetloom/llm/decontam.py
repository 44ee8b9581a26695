"""Benchmark decontamination: a prefix-filtered set join of documents and benchmark items, in DataFrame operations.

A window is `size` consecutive words of an item (all words of a shorter item). Windows are sets of shingles of SHINGLE words
(of all words of an item that has fewer). The shingles of all items are counted over all documents and ordered by rarity; since
a window must be contained whole, one shingle is a sufficient prefix: its rarest. Documents meet items only at these prefix
shingles, which also fix where the item would lie in the document. Length and place bound what can fit; what is left is
verified shingle by shingle, as text, over the item-sized window of the document: runs of agreeing shingles as long as a window are hits.

Each document is split into words once. A table of fixed size, marked by the hashes of the items' shingles, lets only those
positions through that may hold one; these are written and serve counting, meeting and verifying, so texts are not moved.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Defined cases: a null or wordless text has no
words and no hits; an item without words is not used; items with the same id count as one item in the result, each
with its own text; a null item_id is written `null`; repeated document rows get equal results; rows with the same
doc_id and different texts are apart. A very long text is one row of words while it is split, and nothing else of its size. Empty
tables give an empty result, or documents without hits. `judge` reads only doc_id, text and item_id, so further columns cannot
clash; `keep` gives back all columns and joins by names that it takes from no column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, cut, key_of, keyed, mark_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE, SHINGLE = 13, 3
#: Tables of items' shingles up to so many rows are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Slots of the table that lets shingles through: 64 for each shingle of the items, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 15, 1 << 22
_BITS = [bytes(b >> i & 1 for i in range(8)) for b in range(256)]


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """The text column replaced by its words."""
    rest = [c for c in df.columns if c != text]
    parts = df.select(*rest, F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD).alias("__parts"))
    # Only the first and the last part can be empty.
    n, first, last = F.size("__parts"), F.get("__parts", F.lit(0)) == "", F.get("__parts", F.size("__parts") - 1) == ""
    start = F.when(first, 2).otherwise(1)
    return parts.select(*rest, F.slice("__parts", start, F.greatest(n - start + 1 - last.cast("int"), F.lit(0))).alias(name))


def _hash(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _shingle(words: str, at: Column, size: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + k) for k in range(size)])


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_parts(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Ids of the distinct texts of items (row, item), and their shingles (row, n words, window w, shingle size g, q, shingle, hash)."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    rows = with_words(named, "text", "words").where(F.size("words") > 0)
    row = F.unhex(F.substring(F.sha2(F.array_join("words", " "), 256), 1, 32))  # words hold no spaces
    rows = cut(rows.select(row.alias("row"), "item", "words").distinct(), "items")
    n = F.size("words")
    texts = rows.select("row", "words").distinct().select("row", "words", n.alias("n"), F.least(n, F.lit(size)).alias("w"), F.least(n, F.lit(SHINGLE), F.lit(size)).alias("g"))
    at = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("g"))).alias("q"))
    pick = lambda f: F.coalesce(*[F.when(F.col("g") == g, f("words", F.col("q"), g)) for g in range(1, SHINGLE + 1)])
    parts = at.select("row", "n", "w", "g", "q", pick(_shingle).alias("shingle"), pick(_hash).alias("hash"))
    return rows.select("row", "item"), cut(parts, "item_parts")


def _slots(h: Column, n: int) -> tuple[Column, Column]:
    """Two places of a hash in a table of n slots (a power of two), from 0."""
    return h.bitwiseAND(F.lit(n - 1)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(n - 1)).cast("int")


def pass_table(hashes: DataFrame) -> bytes:
    """A byte for each slot: 1 where a hash of (hash) has a place."""
    n = LEAST_SLOTS
    while n < min(MOST_SLOTS, 64 * hashes.count()):
        n *= 2
    marks = hashes.select(F.explode(F.array(*_slots(F.col("hash"), n))).alias("slot"))
    pages = marks.groupBy(F.shiftright("slot", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(0x7FFF)).cast("long")).alias("bits"))
    found = {r.page: bytes(r.bits) for r in pages.collect()}  # of bounded size together: a bit for each slot
    return b"".join(_BITS[b] for page in range(n >> 15) for b in found.get(page, bytes(4096)))


def places(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """A row of each document (pos is -1) and one of each of its shingles that the items may hold: (doc_id, key, mark, n, pos, shingle)."""
    sizes = sorted(r.g for r in parts.select("g").distinct().collect())  # at most SHINGLE
    lets = pass_table(parts.select("hash"))
    on = F.lit(lets)
    marked = lambda slot: F.substring(on, slot + 1, 1) == F.lit(b"\x01")

    rows = with_words(keyed(docs), "text", "words").select("*", F.size("words").alias("n"))
    spread = rows.select("*", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("pos"))
    pos, none = F.col("pos"), F.lit(None).cast("string")

    def passes(g: int) -> Column:
        a, b = _slots(_hash("words", pos, g), len(lets))
        return (pos >= 0) & (pos + g <= F.col("n")) & marked(a) & marked(b)

    if len(sizes) < 2:
        may = passes(sizes[0]) if sizes else F.lit(False)
        shingle = F.when(pos >= 0, _shingle("words", pos, sizes[0])) if sizes else none
        found = spread.where((pos < 0) | may).select("doc_id", "key", "mark", "n", "pos", shingle.alias("shingle"))
    else:
        each = F.array(*[F.when(passes(g), _shingle("words", pos, g)) for g in sizes])
        held = spread.select("doc_id", "key", "mark", "n", "pos", F.explode(F.when(pos < 0, F.array(none)).otherwise(each)).alias("shingle"))
        found = held.where("pos < 0 or shingle is not null")
    return cut(found, "places")


def prefixes(parts: DataFrame, seen: DataFrame) -> DataFrame:
    """The rarest shingle of each window whose shingles all occur: (row, m words of the item, w, g, q, shingle)."""
    df = seen.groupBy("shingle").agg(F.count("*").alias("df"))
    rare = parts.drop("hash").join(cut(df, "shingle_counts"), "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("q") + F.col("g") - F.col("w")), F.least("q", F.col("n") - F.col("w"))
    windows = rare.withColumn("k", F.explode(F.sequence(first, last)))
    rarest = windows.groupBy("row", "k", "n", "w", "g").agg(F.min(F.struct("df", "shingle", "q")).alias("p")).where("p.df > 0")
    return cut(rarest.select("row", F.col("n").alias("m"), "w", "g", F.col("p.q").alias("q"), F.col("p.shingle").alias("shingle")).distinct(), "prefixes")


def hits(seen: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, mark, row, a, b): words a to b of a document are words of an item, and hold whole windows."""
    met = seen.join(_sent(prefixes(parts, seen)), "shingle")
    d = F.col("pos") - F.col("q")  # where the item would start
    fits = F.least(F.col("n"), d + F.col("m")) - F.greatest(F.lit(0), d) >= F.col("w")
    found = cut(met.where(fits).select("key", "mark", "row", d.alias("d")).distinct(), "met")
    wanted = found.join(_sent(parts.drop("n", "hash")), "row").withColumn("pos", F.col("d") + F.col("q")).where("pos >= 0")
    agreed = wanted.join(seen.select("key", "mark", "pos", "shingle"), ["key", "mark", "pos", "shingle"], "left_semi")
    line = Window.partitionBy("key", "mark", "row", "d").orderBy("q")
    runs = agreed.withColumn("run", F.col("q") - F.row_number().over(line)).groupBy("key", "mark", "row", "d", "w", "g", "run").agg(F.min("q").alias("a"), F.max("q").alias("b"))
    whole = runs.where(F.col("b") - F.col("a") + F.col("g") >= F.col("w"))
    return cut(whole.select("key", "mark", "row", (F.col("d") + F.col("a")).alias("a"), (F.col("d") + F.col("b") + F.col("g") - 1).alias("b")), "hits")


def judge(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """For each document doc_id, key, mark, n_words, n_hit, items (sorted ids) and contaminated."""
    names, parts = item_parts(benchmark, size)
    split = places(docs, parts)
    found = hits(split.where("pos >= 0").drop("doc_id"), parts)
    # Words of a hit that no hit before it covers.
    before = F.coalesce(F.max("b").over(Window.partitionBy("key", "mark").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = found.select("key", "mark", F.greatest(F.col("b") - F.greatest(F.col("a") - 1, before), F.lit(0)).alias("fresh"))
    covered = fresh.groupBy("key", "mark").agg(F.sum("fresh").alias("n_hit"))
    items = found.select("key", "mark", "row").distinct().join(names, "row").groupBy("key", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = split.where("pos < 0").join(covered.join(items, ["key", "mark"]), ["key", "mark"], "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n").cast("long")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "key", "mark", n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated")
    )


def keep(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    gone = cut(judge(docs.select("doc_id", "text"), benchmark, size).where("contaminated").select("key", "mark").distinct(), "contaminated")
    names = [f"c{k}" for k in range(len(docs.columns))]  # given names cannot clash with those of the join
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    return rows.join(gone, (key_of(doc_id) == F.col("key")) & (mark_of(doc_id, text) == F.col("mark")), "left_anti").toDF(*docs.columns)
