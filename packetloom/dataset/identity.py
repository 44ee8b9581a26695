"""Identity of a cohort: what decides which packets are kept, and nothing else.

It covers target_flow_id, protocol, the direction-independent endpoints and the exact text of the context source; times,
counts, basis and direction do not enter. Rows are digested in Spark and dealt to a fixed number of groups by digest; a group's
digest is that of its sorted row digests, and the identity that of the groups'. Repeated rows count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "cohort-identity-v1"
#: Hexadecimal digits of a digest that choose the group.
DIGITS = 3


def _text(side: str) -> Column:
    at = F.col(f"key_{side}")
    return F.concat_ws(",", F.hex(at["addr"]), at["port"].cast("string"))


def cohort_identity(cohort: DataFrame) -> str:
    """SHA-256 of a cohort with its key columns."""
    row = F.to_json(F.struct(F.col("target_flow_id").cast("long").alias("id"), F.col("protocol").alias("p"), _text("a").alias("a"), _text("b").alias("b"), F.col("context_source_ip").alias("c")))
    digests = cohort.select(F.sha2(row, 256).alias("d"))
    groups = digests.groupBy(F.substring("d", 1, DIGITS).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    found = groups.orderBy("g").collect()  # 16 ** DIGITS rows at most
    return hashlib.sha256("\n".join([VERSION, *(f"{r.g}:{r.d}" for r in found)]).encode()).hexdigest()
