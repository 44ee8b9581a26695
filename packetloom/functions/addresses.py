"""Packed addresses from their text, in Arrow batches."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def packed_address(text: pd.Series) -> pd.Series:
    """4 or 16 bytes, which compare like the addresses; not an address: an error."""
    known = {x: ipaddress.ip_address(x).packed for x in text.dropna().unique()}
    return text.map(known)


def with_packed(df: DataFrame, *sides: str) -> DataFrame:
    """Add <side>_addr from <side>_ip."""
    return df.withColumns({f"{s}_addr": packed_address(F.col(f"{s}_ip")) for s in sides or ("src", "dst")})
