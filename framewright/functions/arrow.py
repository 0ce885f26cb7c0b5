"""Arrow functions for what 64-bit expressions cannot hold: wrapping words, full-range rationals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import exact


RATIO = T.StructType([T.StructField("den", T.LongType()), T.StructField("num", T.LongType())])


def _u64(seed: pd.Series) -> np.ndarray:
    return seed.to_numpy(np.int64).view(np.uint64)


@F.pandas_udf(T.LongType())
def splitmix(seed: pd.Series, draw: pd.Series) -> pd.Series:
    """The draw-th word (from 1) of each seed, its bits as a BIGINT."""
    return pd.Series(exact.words(_u64(seed), draw.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.LongType())
def walk_seed(base: pd.Series, step: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return pd.Series((_u64(base) + _u64(step) * np.uint64(exact.WALK_STRIDE)).view(np.int64))


@F.pandas_udf(T.LongType())
def bounded(seed: pd.Series, bound: pd.Series) -> pd.Series:
    """The first draw below ``bound`` from each seed, by rejection, all rows together."""
    s, limit = _u64(seed), bound.to_numpy(np.int64)
    top = np.maximum(limit - 1, 0).astype(np.uint64)
    mask = top.copy()
    for k in (1, 2, 4, 8, 16, 32):
        mask |= mask >> np.uint64(k)
    out = np.zeros(len(s), np.int64)
    todo, draw = np.flatnonzero(limit > 1), 1
    while todo.size:
        x = exact.words(s[todo], np.uint64(draw)) & mask[todo]
        good = x <= top[todo]
        out[todo[good]] = x[good].astype(np.int64)
        todo, draw = todo[~good], draw + 1
    return pd.Series(out)


@F.pandas_udf(T.StructType([T.StructField("dx", T.LongType()), T.StructField("dy", T.LongType())]))
def walk_step(seed: pd.Series, step: pd.Series) -> pd.DataFrame:
    """Displacement of one step of a walk, in 1/1024 of its step length."""
    with np.errstate(over="ignore"):
        s = _u64(seed) + _u64(step) * np.uint64(exact.WALK_STRIDE)
    out, have = np.zeros((len(s), 2), np.int64), np.zeros(len(s), np.int64)
    draw = 1
    while (todo := np.flatnonzero(have < 2)).size:
        x = (exact.words(s[todo], np.uint64(draw)) & np.uint64(4095)).astype(np.int64)
        good = x <= 2 * exact.WALK_GRID
        rows = todo[good]
        out[rows, have[rows]] = x[good] - exact.WALK_GRID
        have[rows] += 1
        draw += 1
    return pd.DataFrame(out, columns=["dx", "dy"])


@F.pandas_udf(T.LongType())
def binary32(num: pd.Series, den: pd.Series) -> pd.Series:
    return pd.Series(exact.vector_binary32(num, den))


def ratio_op(op: str):
    """Exact a op b (add, sub, mul, div) on (num, den, num, den) up to reduced parts of 64 bits."""

    @F.pandas_udf(RATIO)
    def run(an: pd.Series, ad: pd.Series, bn: pd.Series, bd: pd.Series) -> pd.DataFrame:
        num, den = exact.vector_ratio(op, an, ad, bn, bd)
        return pd.DataFrame({"den": den, "num": num})

    return run
