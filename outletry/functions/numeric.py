"""Number expressions. Missing is always null: NaN and infinities are removed at the cast."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INF = float("inf")


def finite(value: Column) -> Column:
    """Null in place of NaN (which sorts above infinity) and infinities."""
    return F.when(F.abs(value) < F.lit(_INF), value)


def to_number(text: Column) -> Column:
    """Double from text, null where it is not a number (a Java type suffix such as ``1d`` is none)."""
    return finite(parsed_number(text))


def parsed_number(text: Column) -> Column:
    """As ``to_number``, but NaN and infinities stay."""
    suffixed = F.right(F.trim(text), F.lit(1)).isin("d", "D", "f", "F")
    return F.when(~suffixed, text.try_cast("double"))


def bad_number(text: Column) -> Column:
    """True where there is text that is not a number."""
    return text.isNotNull() & to_number(text).isNull()


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    quotient = finite(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    return quotient if default is None else F.coalesce(quotient, F.lit(float(default)))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bring a value into a range; null stays null although greatest/least would drop it."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even in binary arithmetic (``bround`` rounds the printed decimal instead)."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale if digits else F.rint(value)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def fill_numbers(df: DataFrame, columns: Iterable[str], value: float | int = 0) -> DataFrame:
    """Fill missing and non-finite values in those of ``columns`` that exist."""
    types = {f.name: f.dataType for f in df.schema}
    filled = {}
    for name in columns:
        kind = types.get(name)
        if kind is None:
            continue
        column = F.col(name)
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            column = finite(column)
        elif isinstance(kind, T.StringType):
            column = to_number(column)
        target = "double" if isinstance(kind, T.StringType) else kind.simpleString()
        filled[name] = F.coalesce(column, F.lit(value).cast(target))
    return df.withColumns(filled) if filled else df


def fill_all_numbers(df: DataFrame, exclude: Iterable[str] = (), value: float | int = 0) -> DataFrame:
    """Fill every numeric column but the excluded ones."""
    return fill_numbers(df, numeric_columns(df, exclude), value)
