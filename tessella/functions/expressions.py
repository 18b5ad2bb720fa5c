"""Column expressions: formatting, tolerant buckets, dictionary maps, kernels on arrays. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """``NA`` for null, an integer without decimals, otherwise six significant digits without trailing zeros."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")
    # up to six significant digits, as "%g" has them: larger exponents are left in scientific form
    size = F.floor(F.log10(F.abs(x)))
    digits = F.greatest(F.lit(0), F.lit(5) - size).cast("int")
    rounded = F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), "0+$", ""), r"\.$", "")
    scientific = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e"), r"e([+-])(\d)$", "e$10$2")
    return (F.when(x.isNull() | F.isnan(x), "NA").when(x == F.floor(x), F.format_string("%d", x.cast("bigint")))
            .when((size < -4) | (size > 5), scientific).otherwise(F.coalesce(fixed, plain)))


def near_label(x: Column, values: Sequence[tuple[float, str]], rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Label of the first value that x is close to, or x as text."""
    out = None
    for v, label in values:
        close = F.abs(x - v) <= atol + rtol * abs(v)
        out = F.when(close, label) if out is None else out.when(close, label)
    return out.otherwise(x.cast("string"))


def mapped(x: Column, names: dict[str, str]) -> Column:
    """Dictionary lookup that leaves unknown values as they are."""
    return F.coalesce(F.create_map(*[F.lit(s) for kv in names.items() for s in kv])[x], x)


def first_existing(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of ``names`` that is a column; an error if none is."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of {list(names)} is a column")


def to_number(x: Column) -> Column:
    """Number, or null where the text is none."""
    return x.try_cast("double")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def rbf(a: Column, b: Column, gamma: float | Column) -> Column:
    return F.exp(-(F.lit(gamma) if isinstance(gamma, float | int) else gamma) * squared_distance(a, b))


def linear(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial(a: Column, b: Column, gamma: float = 1.0, degree: int = 3, coef0: float = 1.0) -> Column:
    return F.pow(gamma * dot(a, b) + coef0, F.lit(degree))
