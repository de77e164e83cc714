"""Missing values: a nullable value with a status beside it.

A true zero is a value. Placeholder texts and nulls are MISSING, texts that can't
be read PARSE_FAILURE, values outside their range CONFLICT.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Statuses, and texts that stand for no value.
PARSED, MISSING, PARSE_FAILURE, NOT_APPLICABLE, CONFLICT, UNKNOWN = "PARSED", "MISSING", "PARSE_FAILURE", "NOT_APPLICABLE", "CONFLICT", "UNKNOWN"
PLACEHOLDERS = ("", "no data", "none", "--", "-", "null")


def without_placeholder(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(~F.lower(text).isin(*PLACEHOLDERS), text)


def tagged(raw: Column, parsed: Column) -> tuple[Column, Column]:
    """The parsed value and its status, from the text it was parsed from."""
    status = F.when(without_placeholder(raw).isNull(), MISSING).when(parsed.isNull(), PARSE_FAILURE).otherwise(PARSED)
    return F.when(status == PARSED, parsed), status


def number(raw: Column) -> tuple[Column, Column]:
    return tagged(raw, without_placeholder(raw).try_cast("double"))


def judged(raw: Column, parsed: Column, applies: Column, agrees: Column) -> tuple[Column, Column]:
    """As tagged(), for fields that not every row can have and that other evidence may contradict: NOT_APPLICABLE where
    the field makes no sense for the row, CONFLICT where a value is there and other evidence says otherwise. Neither
    keeps a value; unknown evidence contradicts nothing."""
    value, status = tagged(raw, parsed)
    conflict = (status == PARSED) & ~F.coalesce(agrees, F.lit(True))
    status = F.when(~F.coalesce(applies, F.lit(True)), NOT_APPLICABLE).when(conflict, CONFLICT).otherwise(status)
    return F.when(status == PARSED, value), status


def text_or_unknown(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN))
