"""Vector scores and quantized forms, as array expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2(a, b) -> Column:
    """Minus the squared distance: higher is closer."""
    return -F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)


def cosine(a, b) -> Column:
    """The dot product of the normalized vectors; 0 if one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


SCORES = {"cosine": cosine, "dot": dot, "l2": l2}


def normalized(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(_c(a).cast("array<double>"))


def quantize_i8(a) -> Column:
    """struct(values, scale, offset): [min, max] mapped onto [-128, 127]. A constant vector has
    scale 1 and itself as the offset."""
    a = _c(a).cast("array<double>")
    low, high = F.array_min(a), F.array_max(a)
    scale = F.when(high > low, (high - low) / 255).otherwise(1.0)
    offset = F.when(high > low, low + 128 * ((high - low) / 255)).otherwise(F.coalesce(low, F.lit(0.0)))
    values = F.transform(a, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round((x - offset) / scale).cast("int"))))
    return F.struct(values.alias("values"), scale.alias("scale"), offset.alias("offset"))


def dequantize_i8(q) -> Column:
    q = _c(q)
    return F.transform(q["values"], lambda v: v * q["scale"] + q["offset"])


def quantize_u1(a) -> Column:
    """struct(words, norm, alignment, dimension): a bit is set for every positive element, 63 bits
    to a word."""
    a = _c(a).cast("array<double>")
    n = F.size(a)
    word = lambda w: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(F.get(a, w * 63 + i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, x: t + x)
    words = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / 63).cast("int")), word)
    length = norm(a)
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + F.abs(x))
    return F.struct(words.alias("words"), length.alias("norm"), F.when(length > 0, total / (length * F.sqrt(n.cast("double")))).otherwise(0.0).alias("alignment"), n.alias("dimension"))


def dequantize_u1(q) -> Column:
    """Plus or minus norm / sqrt(dimension) for each element."""
    q = _c(q)
    size = q["norm"] / F.sqrt(q["dimension"].cast("double"))
    bit = lambda i: F.call_function("shiftright", F.get(q["words"], F.floor(i / 63).cast("int")), i % 63).bitwiseAND(1)
    return F.transform(F.sequence(F.lit(0), q["dimension"] - 1), lambda i: F.when(bit(i) == 1, size).otherwise(-size))


def hamming(a, b) -> Column:
    """How many of the dimension's bits two 1-bit forms share."""
    a, b = _c(a), _c(b)
    return a["dimension"] - F.aggregate(F.zip_with(a["words"], b["words"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def estimated_dot(query: Column, q) -> Column:
    """The dot product of a query and a 1-bit form, corrected for its alignment; 0 without one."""
    q = _c(q)
    signs = F.transform(dequantize_u1(q), lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    return F.when(q["alignment"] > 0, q["norm"] * dot(query, signs) / (F.sqrt(q["dimension"].cast("double")) * q["alignment"])).otherwise(0.0)


def half(a) -> Column:
    """Elements rounded to 16-bit floats."""

    @F.arrow_udf("array<float>")
    def rounded(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.array(v, np.float16).astype(np.float32) for v in x.to_pylist()], pa.list_(pa.float32()))

    return rounded(_c(a))


def prefix(a, n: int, element: str = "f32") -> Column:
    """The first n elements; quantized forms have no prefix and none reaches past the dimension."""
    if element not in ("f16", "f32"):
        raise ValueError("only float columns have prefixes")
    a = _c(a)
    return F.when(F.size(a) >= n, F.slice(a, 1, n)).otherwise(F.raise_error(F.lit("the prefix is longer than the vector")))
