"""CRC-32 of a concatenation from the CRC-32s of its parts, as a commutative aggregate.

Appending n bytes to a part multiplies its CRC by x^(8n) in GF(2). So the CRC of parts in
order is the exclusive or of each part's CRC, shifted by the bytes that follow it; the
order only enters through that number, and partial aggregation works."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYNOMIAL = 0xEDB88320


@functools.cache
def _operators() -> np.ndarray:
    """ops[k, i]: bit i of a CRC after 2**k zero bytes. By squaring; 63 lengths."""
    one = np.array([POLYNOMIAL if i == 0 else 1 << (i - 1) for i in range(32)], np.uint32)  # one zero bit

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _apply(a, b)

    op = one
    for _ in range(3):
        op = times(op, op)
    out = [op]
    for _ in range(62):
        out.append(times(out[-1], out[-1]))
    return np.stack(out)


def _apply(op: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape, np.uint32)
    for i in range(32):
        out ^= np.where((values >> np.uint32(i)) & np.uint32(1), op[i], np.uint32(0))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRCs of parts, as they count in a whole where ``after`` bytes follow them."""
    out, ops = crc.astype(np.uint32), _operators()
    for k in range(63):
        some = (after >> k) & 1 == 1
        if some.any():
            out = np.where(some, _apply(ops[k], out), out)
        if not (after >> (k + 1)).any():
            break
    return out


@F.pandas_udf(T.LongType())
def crc32_shift(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(shifted(crc.to_numpy(np.int64), after.to_numpy(np.int64)).astype(np.int64), index=crc.index)


def combine_crc(parts: DataFrame, keys: list[str], order: list[str], crc: str = "crc32", length: str = "raw_len") -> DataFrame:
    """keys, crc32, total and parts of each group, from its parts' checksums in order.

    One window for the bytes that follow, then a commutative aggregation with partial
    results before its shuffle."""
    later = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum(length).over(later), F.lit(0))
    return (
        parts.select(*keys, F.col(crc).alias("c__"), F.col(length).alias("n__"), after.alias("a__"))
        .select(*keys, "n__", crc32_shift("c__", "a__").alias("s__"))
        .groupBy(*keys)
        .agg(F.bit_xor("s__").alias("crc32"), F.sum("n__").alias("total"), F.count(F.lit(1)).alias("parts"))
    )

