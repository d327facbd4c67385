"""Scalar quantization to 8 or 4 bits: calibration by aggregation, codes and distances as expressions.

A calibration is a few numbers per dimension; it is collected once and enters expressions as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions import kernels as K

LEVELS = {"sq8": 255, "sq4": 15}


@dataclass(frozen=True)
class Calibration:
    """Per dimension minimum, step and c = step * minimum (as floats), and K, the squared length of the minimum."""

    low: np.ndarray
    high: np.ndarray
    step: np.ndarray
    c: np.ndarray
    k: float
    levels: int

    @property
    def packed(self) -> bool:
        return self.levels == 15


def dimension_ranges(df: DataFrame, vec: str = "vec") -> DataFrame:
    """d, low, high of every dimension; combined map-side, so a few rows per task are shuffled."""
    return df.select(F.posexplode(vec).alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def calibrate(df: DataFrame, encoding: str, vec: str = "vec") -> Calibration:
    rows = dimension_ranges(df, vec).orderBy("d").collect()
    if not rows:
        raise ValueError("cannot calibrate an empty index")
    low, high = (np.array([r[c] for r in rows], np.float32) for c in ("low", "high"))
    high = np.where(high <= low, (low.astype(np.float64) + 1e-6).astype(np.float32), high)
    levels = LEVELS[encoding]
    step = ((high.astype(np.float64) - low) / levels).astype(np.float32)
    c = (step.astype(np.float64) * low).astype(np.float32)
    return Calibration(low, high, step, c, float((low.astype(np.float64) ** 2).sum()), levels)


def _literal(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def encode(vec: Column, cal: Calibration) -> Column:
    """Codes (array of int): round half up, clamped to 0 .. levels; a step of 0 gives 0 or the clamp."""

    def code(x: Column, p: Column) -> Column:
        off, step = x.cast("double") - p["low"], p["step"]
        flat = F.when(off > 0, F.lit(float(cal.levels))).otherwise(F.lit(0.0))
        q = F.when(step == 0, flat).otherwise(F.floor(off / F.when(step == 0, F.lit(1.0)).otherwise(step) + 0.5).cast("double"))
        return F.least(F.greatest(q, F.lit(0.0)), F.lit(float(cal.levels))).cast("int")

    params = F.arrays_zip(_literal(cal.low).alias("low"), _literal(cal.step).alias("step"))
    return F.zip_with(vec, params, code)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def pack(codes: Column, cal: Calibration) -> Column:
    """Codes as binary: a byte per dimension, or two dimensions per byte with the even one in the low half."""
    one = lambda x: F.lpad(F.hex(x), 2, "0")
    if not cal.packed:
        return F.unhex(F.array_join(F.transform(codes, one), ""))
    places = lambda c: F.sequence(F.lit(0), F.size(c) - 1, F.lit(2))
    pairs = _let(codes, lambda c: F.transform(places(c), lambda i: F.get(c, i) + 16 * F.coalesce(F.get(c, i + 1), F.lit(0))))
    return F.unhex(F.array_join(F.transform(pairs, one), ""))


def unpack(data: Column, cal: Calibration) -> Column:
    """Codes of what ``pack`` made."""
    n = len(cal.low)

    def of(h: Column) -> Column:
        digit = lambda at: F.conv(F.substring(h, at, F.lit(1)), 16, 10).cast("int")
        if cal.packed:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: digit(d + 2 - 2 * (d % 2)))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: digit(2 * d + 1) * 16 + digit(2 * d + 2))

    return _let(F.hex(data), of)


def decode(codes: Column, cal: Calibration) -> Column:
    """The vector that codes stand for, as floats."""
    params = F.arrays_zip(_literal(cal.low).alias("low"), _literal(cal.step).alias("step"))
    return F.zip_with(codes, params, lambda q, p: (q * p["step"] + p["low"]).cast("float"))


def aux(codes: Column, cal: Calibration) -> Column:
    """Struct of dot_c, norm, self_w and xsm of codes: what the algebraic forms of the distances need."""
    p = F.arrays_zip(codes.alias("q"), _literal(cal.low).alias("low"), _literal(cal.step).alias("step"), _literal(cal.c).alias("c"))
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, x: a + x)
    value = lambda x: x["q"] * x["step"] + x["low"]
    return F.struct(
        total(lambda x: x["q"] * x["c"]).alias("dot_c"),
        F.sqrt(total(lambda x: value(x) * value(x))).alias("norm"),
        total(lambda x: x["q"] * x["q"] * x["step"] * x["step"]).alias("self_w"),
        total(lambda x: x["q"] * x["step"] * x["low"]).alias("xsm"),
    )


def asymmetric_euclidean(query: Column, codes: Column, aux_: Column, cal: Calibration) -> Column:
    """|q - decoded| without decoding: from the query and the codes' scalars."""
    p = F.arrays_zip(query.alias("v"), codes.alias("q"), _literal(cal.low).alias("low"), _literal(cal.step).alias("step"))
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, x: a + x)
    v = lambda x: x["v"].cast("double")
    cross = total(lambda x: v(x) * x["step"] * x["q"]) + total(lambda x: v(x) * x["low"])
    return F.sqrt(F.greatest(F.lit(0.0), K.dot(query, query) - 2 * cross + aux_["self_w"] + 2 * aux_["xsm"] + F.lit(cal.k)))


def symmetric(qa: Column, aa: Column, qb: Column, ab: Column, cal: Calibration, metric: str) -> Column:
    """Distance of two coded vectors."""
    p = F.arrays_zip(qa.alias("a"), qb.alias("b"), _literal(cal.step).alias("step"))
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, x: a + x)
    if metric == "euclidean":
        diff = lambda x: (x["a"] - x["b"]) * x["step"]
        return F.sqrt(total(lambda x: diff(x) * diff(x)))
    ip = total(lambda x: x["a"] * x["b"] * x["step"] * x["step"]) + aa["dot_c"] + ab["dot_c"] + F.lit(cal.k)
    if metric == "dot":
        return -ip
    den = aa["norm"] * ab["norm"]
    return F.when(den == 0, F.lit(1.0)).otherwise(1 - ip / F.when(den == 0, F.lit(1.0)).otherwise(den))
