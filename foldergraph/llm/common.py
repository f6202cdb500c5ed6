"""Helpers that the operators share: row keys, null-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09-\x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where rows are put in order.
NO_ID = -(2**63)


def text_key() -> Column:
    """Tells rows of one doc_id apart by their text; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def same_row(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; b's keys are dropped."""
    other = b.select(*[F.col(k).alias(f"_b_{k}") if k in keys else F.col(k) for k in b.columns])
    on = [a[k].eqNullSafe(other[f"_b_{k}"]) for k in keys]
    return a.join(other, on, how).drop(*[f"_b_{k}" for k in keys])
