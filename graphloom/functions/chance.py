"""Pseudo-random numbers that are functions of their arguments, the same in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seed where none is given.
SEED = 20_222_022


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of seed and keys, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same in DuckDB's SQL."""
    text = " || ':' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def hashed(feature: Column, h: int, dims: int) -> tuple[Column, Column]:
    """(dimension, sign) of a feature under the ``h``-th hash: the sign from the lowest bit, the dimension from the others."""
    x = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(h)), feature.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.floor(x / 2).cast("bigint") % dims, (2 * (x % 2) - 1).cast("double")


def hashed_sql(feature: str, h: str, dims: int) -> tuple[str, str]:
    x = f"('0x' || substr(md5(CAST({h} AS VARCHAR) || ':' || CAST({feature} AS VARCHAR)), 1, 8))::BIGINT"
    return f"(({x} // 2) % {dims})", f"CAST(2 * ({x} % 2) - 1 AS DOUBLE)"
