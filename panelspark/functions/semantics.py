"""Column helpers that give Spark the missing-value and IEEE behaviour of the analyses.

Spark (ANSI mode) returns NULL for ``ln(0)`` and raises on ``x / 0``; the analyses rely on
``log(0) = -Inf``, ``log(<0) = NaN``, ``x/0 = +-Inf`` and ``0/0 = NaN``, and on an if-else
that propagates a missing condition. Every helper is a plain ``Column`` expression, so it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

INF = float("inf")
NAN = float("nan")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rln(c: str | Column) -> Column:
    """Natural log with IEEE results: ln(0) = -inf, ln(<0) = NaN, ln(NaN) = NaN, NULL stays NULL."""
    c = col(c)
    return (
        F.when(F.isnan(c), F.lit(NAN))
        .when(c > 0, F.ln(c))
        .when(c == 0, F.lit(-INF))
        .when(c < 0, F.lit(NAN))
    )


def rlog10(c: str | Column) -> Column:
    """Base-10 log with the same IEEE conventions as :func:`rln`."""
    c = col(c)
    return (
        F.when(F.isnan(c), F.lit(NAN))
        .when(c > 0, F.log10(c))
        .when(c == 0, F.lit(-INF))
        .when(c < 0, F.lit(NAN))
    )


def rdiv(a: str | Column, b: str | Column) -> Column:
    """IEEE division a / b: x/0 = +-inf, 0/0 = NaN, NaN/0 = NaN, NULL if either side is NULL.

    The order of the branches matters: ``NaN > 0`` is true in Spark, so the NaN numerator
    is tested before the sign tests.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = b == 0
    return (
        F.when(b != 0, a / b)
        .when(zero & F.isnan(a), F.lit(NAN))
        .when(zero & (a > 0), F.lit(INF))
        .when(zero & (a < 0), F.lit(-INF))
        .when(zero & (a == 0), F.lit(NAN))
    )


def ifelse_na(cond: Column, yes, no) -> Column:
    """Vector if-else where a missing condition gives a missing result (not the else branch)."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def is_infinite(c: str | Column) -> Column:
    c = col(c)
    return F.abs(c) == F.lit(INF)


def is_missing(c: str | Column) -> Column:
    """NULL or NaN (the analyses' ``is.na`` is true for both)."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def finite_or_zero(c: str | Column) -> Column:
    """+-Inf, NaN and NULL become 0; finite values pass through."""
    c = col(c)
    return F.when(is_missing(c) | is_infinite(c), F.lit(0.0)).otherwise(c)


def inf_to_zero(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace +-Inf, NaN and NULL by 0 in every floating / numeric column (or ``cols``)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cols = list(cols)
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    repl = {}
    for c in cols:
        if c in floating:
            repl[c] = finite_or_zero(c)
        else:
            repl[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
    return df.withColumns(repl)


def try_number(c: str | Column, to: str = "double") -> Column:
    """Numeric coercion where a failure gives NULL (surrounding blanks are ignored)."""
    return col(c).try_cast(to)


def id_scale(c: str | Column, factor: int = 100000) -> Column:
    """Divide an integer id by ``factor`` when it divides exactly, else NULL.

    An id that does not end in the right number of zeros cannot match anything after the
    division, so it is mapped to NULL instead of a fractional key.
    """
    c = col(c).cast("bigint")
    return F.when(c % factor == 0, F.floor(c / factor).cast("bigint"))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Row-wise sum of w * column over a {column: weight} map; NULL in any term gives NULL."""
    return reduce(add, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def significant_decimals(df: DataFrame, digits: int = 2) -> dict[str, int]:
    """Decimals of each numeric column: the most that any entry needs for ``digits`` significant
    digits, not counting zeros at their end. One aggregate over the table."""
    aggs = []
    for c in numeric_columns(df):
        x = F.abs(F.col(c).cast("double"))
        x = F.when((x > 0) & (x < F.lit(INF)), x)
        e = F.floor(F.log10(x))
        m = F.round(x / F.pow(F.lit(10.0), e - digits + 1)).cast("bigint")    # `digits` digits, or one more
        e = e + F.when(m >= 10 ** digits, 1).otherwise(0)
        zeros = F.length(F.regexp_extract(m.cast("string"), "(0*)$", 1)) - F.when(m >= 10 ** digits, 1).otherwise(0)
        aggs.append(F.max(F.greatest(F.lit(0), digits - zeros - 1 - e)).alias(c))
    if not aggs:
        return {}
    return {c: int(n or 0) for c, n in df.agg(*aggs).first().asDict().items()}


def format_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Render every numeric column as text with ``digits`` significant digits for its smallest
    entry and one number of decimals for the whole column (no thousands separators)."""
    decimals = significant_decimals(df, digits)

    def shown(c: str) -> Column:
        x = F.col(c).cast("double")
        text = F.format_string(f"%.{decimals[c]}f", x)
        return F.when(x.isNull(), F.lit("NA")).when(F.isnan(x), F.lit("NaN")).when(
            F.abs(x) == F.lit(INF), F.when(x > 0, F.lit("Inf")).otherwise(F.lit("-Inf"))).otherwise(text)

    return df.withColumns({c: shown(c) for c in decimals})


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double column (for stable comparison / display)."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), decimals) for c in cols})
