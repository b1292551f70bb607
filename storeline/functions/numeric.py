"""Number parsing, ids, guarded arithmetic and global scaling as Column / DataFrame helpers.

Everything here compiles to built-in Catalyst expressions (whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number as pandas ``to_numeric`` accepts it: optional blanks and sign,
# digits with an optional fraction, optional exponent, or inf / nan words.
# Spark's own cast is looser ('12d' -> 12.0, '0x1p3' -> 8.0), hence the guard.
NUMBER_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def num_expr(c: Column, dtype: T.DataType) -> Column:
    """Guarded number: numeric input stays numeric (decimals stay exact);
    text is parsed only when the whole value is a number. NaN becomes NULL."""
    if isinstance(dtype, (T.DecimalType, T.IntegralType)):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    s = c.cast("string")
    parsed = F.when(F.lower(s).rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def num(df: DataFrame, name: str) -> Column:
    """``num(x)`` of the survey: guarded parse of column ``name`` of ``df``; NULL when absent."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    return num_expr(F.col(name), _dtype(df, name))


def num0(df: DataFrame, name: str) -> Column:
    """Number with invalid / missing values as 0 (``to_numeric(...).fillna(0)``)."""
    if name not in df.columns:
        return F.lit(0)
    return F.coalesce(num(df, name), F.lit(0))


def canonical_id(df: DataFrame, name: str) -> Column:
    """Join key as STRING. Integral numbers print without a trailing '.0';
    NULL stays NULL (never the text 'nan')."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    dt = _dtype(df, name)
    c = F.col(name)
    if isinstance(dt, T.IntegralType):
        return c.cast("string")
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        return (F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string"))
                .when(d == F.floor(d), F.floor(d).cast("decimal(38,0)").cast("string"))
                .otherwise(c.cast("string")))
    return c.cast("string")


def guarded_ratio(n: Column, d: Column) -> Column:
    """``n / d`` when ``d > 0`` else 0, in double precision."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    """inf / NaN / NULL -> 0.0 (for doubles)."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(d)


def minmax_scale(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Min-max scale several columns to 0..1 in one pass.

    ``cols`` maps output name -> input column. NULL counts as 0; a constant
    column scales to 0. The global min / max come from ONE one-row aggregate,
    joined back as a broadcast (its size is one row whatever the input size),
    so no window without a partition key ever pulls all rows into one task.
    """
    if not cols:
        return df
    filled = {out: F.coalesce(F.col(src).cast("double"), F.lit(0.0)) for out, src in cols.items()}
    stats = df.agg(*[F.min(e).alias(f"__mn_{o}") for o, e in filled.items()],
                   *[F.max(e).alias(f"__mx_{o}") for o, e in filled.items()])
    joined = df.crossJoin(F.broadcast(stats))
    for out, e in filled.items():
        mn, mx = F.col(f"__mn_{out}"), F.col(f"__mx_{out}")
        joined = joined.withColumn(
            out, F.when(mn.isNull() | mx.isNull() | (mx == mn), F.lit(0.0)).otherwise((e - mn) / (mx - mn)))
    return joined.drop(*[c for c in joined.columns if c.startswith("__mn_") or c.startswith("__mx_")])
