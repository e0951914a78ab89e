"""Row rules that collect every reason for which a row is refused."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = "_reasons"
REASON_TEXT = "_dq_rejection_reason"
SEPARATOR = " | "
BROKEN_LINE = "_corrupt_record"


@dataclass(frozen=True)
class Rule:
    """A reason and the condition under which a row breaks the rule (null: not broken)."""

    reason: str
    broken: Column


def mandatory(columns: Sequence[str]) -> list[Rule]:
    return [Rule(f"Missing mandatory field: {c}", F.col(c).isNull()) for c in columns]


def reasons(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(r.broken, F.lit(r.reason)) for r in rules]))


def with_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the reasons of all broken rules, in rule order, after any already there."""
    found = reasons(rules)
    if REASONS in df.columns:
        found = F.concat(F.col(REASONS), found)
    return df.withColumn(REASONS, found)


def with_broken_lines(df: DataFrame) -> DataFrame:
    """Refuse rows of lines that the scan could not split into its columns."""
    if BROKEN_LINE not in df.columns:
        return df
    return with_reasons(df, [Rule("Malformed line", F.col(BROKEN_LINE).isNotNull())])


def is_valid() -> Column:
    return F.size(REASONS) == 0


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(is_valid()).drop(REASONS)


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_valid()).withColumn(
        REASON_TEXT, F.array_join(REASONS, SEPARATOR)
    ).drop(REASONS)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
