"""Mixing sources to target weights: token budgets flow down a tree of domains, languages and sources.

A node's budget is shared among its children by weight. A child cannot use more than its capacity (the
tokens below it times max_epochs); what it leaves goes to its siblings by weight, and only what all of them
leave goes up, since a node's own capacity is the sum of its children's. Each leaf then takes whole epochs
and a token-prefix of one more: its documents in the seeded order of that epoch, up to the last whose
running sum of tokens fits.

Shortages are resolved in closed form by sorting children by capacity over weight. The prefix is found from
sums over hash groups of the order and from the one group where the budget ends, so no leaf meets in one task.

Defined cases: null level values form a node of their own; a level value without a given weight gets
`other`; a weight of 0 takes nothing; a null or wordless text has no tokens and is taken as often as its leaf
has whole epochs (and in the prefix when it comes before the cut). Repeated rows are documents of their own with
the same place in the order: ties are taken or left together, except where their tokens do not fit. An empty
table gives an empty result. Names of further columns may clash with none: only the level columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, word_count

#: Leaf tables up to this size are sent to every task; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Level:
    name: str
    weights: Mapping[str, float] = field(default_factory=dict)
    other: float = 1.0

    def weight(self) -> Column:
        out = F.lit(float(self.other))
        for value, w in self.weights.items():
            out = F.when(F.col(self.name) == value, F.lit(float(w))).otherwise(out)
        return out


def fill(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share `__budget` among the nodes of each parent by `__w`, none over its `__cap`; the share replaces it."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of.orderBy(F.col("__r").asc(), F.col(name).asc_nulls_first())
    lower, upper = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ratio = F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).otherwise(F.lit(float("inf")))
    level = F.try_divide(F.col("__budget") - F.coalesce(F.sum("__cap").over(lower), F.lit(0.0)), F.sum("__w").over(upper))
    full = (F.col("__w") > 0) & (F.col("__level") >= F.col("__r"))
    share = F.when(full, F.col("__cap")).when(F.col("__w") > 0, F.col("__w") * F.col("__at")).otherwise(F.lit(0.0))
    return (
        nodes.withColumn("__r", ratio)
        .withColumn("__level", level)
        .withColumn("__full", full)
        .withColumn("__at", F.first(F.when(~F.col("__full"), F.col("__level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("__budget", share)
        .drop("__r", "__level", "__full", "__at")
    )


def leaf_budgets(leaves: DataFrame, levels: Sequence[Level], share: float, max_epochs: int) -> DataFrame:
    """Whole tokens for each leaf of (level names, tokens): `budget`. The tree is as large as the set of leaves."""
    names = [level.name for level in levels]
    nodes = leaves.withColumn("__cap", F.col("tokens").cast("double") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("double").alias("__budget"))
    above, given = [], total
    for depth, level in enumerate(levels):
        here = nodes.groupBy(*names[: depth + 1]).agg(F.sum("__cap").alias("__cap")).withColumn("__w", level.weight())
        if depth:
            right = given.select(*[F.col(c).alias(f"__u_{c}") for c in above], "__budget")
            same = [F.col(c).eqNullSafe(F.col(f"__u_{c}")) for c in above]
            joined = here.join(right, same).drop(*[f"__u_{c}" for c in above])
        else:
            joined = here.join(F.broadcast(given))  # one row
        given = fill(joined, above, level.name).drop("__cap", "__w")
        above = names[: depth + 1]
    return given.withColumn("budget", F.floor("__budget").cast("long")).drop("__budget")


def mix(
    docs: DataFrame, levels: Sequence[Level], share: float = 0.6, max_epochs: int = 2, seed: str = "mix-1", key: str = "doc_id"
) -> DataFrame:
    """The documents with two more columns: `__tokens` and `__copies`, how often the mix takes each."""
    names = [level.name for level in levels]
    rows = docs.withColumn("__tokens", word_count(F.col("text")))
    slim = cut(rows.select(key, *names, "__tokens"), "mix")
    leaves = slim.groupBy(*names).agg(F.sum("__tokens").alias("tokens"))
    budget = leaf_budgets(leaves, levels, share, max_epochs)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    plan = leaves.alias("l").join(budget.alias("b"), same("l", "b")).select(*[F.col(f"l.{c}") for c in names], "tokens", "budget")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    plan = plan.select(*names, F.least(whole, F.lit(max_epochs)).cast("long").alias("__whole"), "tokens", "budget")
    plan = cut(plan.select(*names, "__whole", (F.col("budget") - F.col("__whole") * F.col("tokens")).alias("__rest")), "mix_plan")
    small = plan.count() <= BROADCAST_LEAVES
    sent = lambda df: F.broadcast(df) if small else df

    def placed(df: DataFrame, leaf: DataFrame) -> DataFrame:
        """With each row's leaf and its place in the order of the epoch that the leaf cuts."""
        right = leaf.select(*[F.col(c).alias(f"__l_{c}") for c in names], *[c for c in leaf.columns if c not in names])
        out = df.join(sent(right), [F.col(c).eqNullSafe(F.col(f"__l_{c}")) for c in names]).drop(*[f"__l_{c}" for c in names])
        place = F.md5(F.concat_ws("|", F.lit(seed), F.col("__whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        return out.withColumn("__place", place)

    # Where the rest of the budget ends: first the hash group, then the place within it.
    ordered = placed(slim, plan).withColumn("__group", F.substring("__place", 1, 3))
    groups = ordered.groupBy(*names, "__group").agg(F.sum("__tokens").alias("__sum"))
    before = Window.partitionBy(*names).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    last = plan.alias("p").join(groups.alias("g"), same("p", "g")).where("__before + __sum > __rest and __before <= __rest").select(
        *[F.col(f"p.{c}") for c in names], "__whole", "__rest", F.col("__group").alias("__end"), "__before"
    )
    within = Window.partitionBy(*names).orderBy("__place", "__tokens").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        placed(slim, last)
        .where(F.substring("__place", 1, 3) == F.col("__end"))
        .withColumn("__run", F.col("__before") + F.sum("__tokens").over(within))
        .where("__run > __rest")
        .groupBy(*names)
        .agg(F.min(F.struct("__place", "__tokens")).alias("__cut"))
    )
    right = cuts.select(*[F.col(c).alias(f"__c_{c}") for c in names], "__cut")
    final = plan.join(right, [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in names], "left").drop(*[f"__c_{c}" for c in names])
    final = cut(final, "mix_cuts")
    out = placed(rows, final)
    taken = (F.col("__rest") > 0) & (F.col("__cut").isNull() | (F.struct("__place", "__tokens") < F.col("__cut")))
    return out.withColumn("__copies", F.col("__whole") + taken.cast("long")).drop("__whole", "__rest", "__cut", "__place")
