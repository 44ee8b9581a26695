"""Column expressions for endpoints, keys, flags and gapless ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TCP, UDP = 6, 17
FIN, SYN, RST, ACK = 1, 2, 4, 16
CONTROL = FIN | SYN | RST


def endpoint(side: str) -> Column:
    """Comparable endpoint of a packet side: packed address, then port."""
    return F.struct(F.col(f"{side}_addr").alias("addr"), F.col(f"{side}_port").alias("port"))


def with_key(packets: DataFrame) -> DataFrame:
    """Add the direction-independent key: key_a is the smaller endpoint, key_b the larger."""
    a, b = endpoint("src"), endpoint("dst")
    return packets.withColumns({"key_a": F.least(a, b), "key_b": F.greatest(a, b)})


KEY = ("key_a", "key_b", "protocol")


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def plain_syn(flags: Column) -> Column:
    return has(flags, SYN) & ~has(flags, ACK)


def gapless_ids(df: DataFrame, order: str, name: str, span: int = 1 << 16, first: int = 1) -> DataFrame:
    """Number rows by a unique non-negative long column, from `first`, without one task for all rows.

    Rows fall into ranges of `span` values; a range starts after the rows of those before it.
    """
    ranged = df.withColumn("__range", F.floor(F.col(order) / span))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy(order)
    numbered = ranged.join(starts, "__range").withColumn(name, (F.col("__start") + F.row_number().over(within) + (first - 1)).cast("long"))
    return numbered.drop("__range", "__start")


def first_by(value: Column | str, order: Column | str, where: Column | None = None) -> Column:
    """Value of the row that comes first, among those where the condition holds."""
    if where is None:
        return F.min_by(value, order)
    return F.min_by(value, F.when(where, F.col(order) if isinstance(order, str) else order))


def renamed(df: DataFrame, names: dict[str, str], columns: Sequence[str]) -> DataFrame:
    back = {v: k for k, v in names.items()}
    return df.select(*[F.col(back.get(c, c)).alias(c) for c in columns])
