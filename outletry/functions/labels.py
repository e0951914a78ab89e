"""Canonical spellings of the categorical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outletry import config
from outletry.functions.text import recode, squash, title_case


def outlet_size(text: Column) -> Column:
    titled = title_case(squash(text))
    return F.when(~titled.isin(*config.SIZE_NULL_WORDS), titled)


def outlet_type(text: Column) -> Column:
    return recode(title_case(squash(text)), config.OUTLET_TYPE_TYPOS)


def seasonality(text: Column) -> Column:
    return recode(squash(F.translate(F.lower(text), "_", "-")), config.SEASONALITY_SYNONYMS)


def holiday_type(text: Column) -> Column:
    return recode(title_case(squash(text)), config.HOLIDAY_TYPE_SYNONYMS)
