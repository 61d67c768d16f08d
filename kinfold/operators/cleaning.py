"""Cleaning steps. Each is narrow: one projection over the scan, no shuffle, no Python."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import DATE_FORMATS, currency_amount, currency_code, parse_date
from ..functions.text import strip, title_case
from .dedup import dedup_exact

_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_FLOATS = ("float", "double")


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def _rewrite(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    present = {name: c for name, c in changed.items() if name in df.columns}
    return df.withColumns(present) if present else df


def strip_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip every string column, or the named ones."""
    return _rewrite(df, {c: strip(F.col(c)) for c in (columns or string_columns(df))})


def normalize_case(df: DataFrame, lower: Sequence[str] = ("email",), title: Sequence[str] = ("name",)) -> DataFrame:
    """Lower-case e-mails, title-case names; absent columns are skipped."""
    return _rewrite(df, {**{c: F.lower(F.col(c)) for c in lower}, **{c: title_case(F.col(c)) for c in title}})


def fill_nulls(df: DataFrame) -> DataFrame:
    """Nulls become "", 0 or 0.0 by column type; booleans, dates and nested columns stay null."""
    defaults: dict[str, object] = {}
    for name, kind in df.dtypes:
        if kind == "string":
            defaults[name] = ""
        elif kind in _INTEGERS:
            defaults[name] = 0
        elif kind in _FLOATS:
            defaults[name] = 0.0
    return df.na.fill(defaults) if defaults else df


def count_nulls(df: DataFrame) -> DataFrame:
    """One row: nulls per column and ``total_nulls``; a map-side aggregate, one row per task is shuffled."""
    per_column = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in df.columns], F.lit(0).cast("bigint"))
    return df.agg(*per_column).withColumn("total_nulls", total)


def upper_columns(df: DataFrame, columns: Sequence[str] = ("country",)) -> DataFrame:
    return _rewrite(df, {c: F.upper(F.col(c)) for c in columns})


def parse_dates(df: DataFrame, columns: Sequence[str] = ("joined_at",), formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    return _rewrite(df, {c: parse_date(F.col(c), formats) for c in columns})


def parse_currencies(df: DataFrame, columns: Sequence[str] = ("salary",)) -> DataFrame:
    """Replace each amount column by ``<c>_amount`` and ``<c>_currency``."""
    for c in (c for c in columns if c in df.columns):
        parsed = {f"{c}_amount": currency_amount(F.col(c)), f"{c}_currency": currency_code(F.col(c))}
        df = df.withColumns(parsed).drop(c)
    return df


def clean(df: DataFrame, date_columns: Sequence[str] = ("joined_at",), currency_columns: Sequence[str] = ("salary",)) -> DataFrame:
    """The whole cleaning step in its fixed order: strip, case, null fill, country, dates, amounts."""
    return (
        df.transform(strip_strings)
        .transform(normalize_case)
        .transform(fill_nulls)
        .transform(upper_columns)
        .transform(parse_dates, date_columns)
        .transform(parse_currencies, currency_columns)
    )


def clean_light(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Lower and strip name and e-mail, one row per e-mail (the first by id), sorted by id."""
    text = {c: strip(F.lower(F.col(c))) for c in ("name", "email")}
    return dedup_exact(_rewrite(df, text), ["email"], id_col).orderBy(id_col)


# ---------------------------------------------------------------- configurable rules


def _text_rule(kind: str, config: Mapping[str, object], c: Column) -> Column:
    if kind == "TRIM":
        return strip(c)
    if kind == "UPPERCASE":
        return F.upper(c)
    if kind == "LOWERCASE":
        return F.lower(c)
    if kind == "DATE_NORMALIZE":
        return parse_date(c, config.get("formats") or DATE_FORMATS)
    if kind == "REGEX_REPLACE":
        return F.regexp_replace(c, str(config["pattern"]), str(config.get("replacement", "")))
    raise ValueError(f"unknown cleaning rule type {kind!r}")


def apply_rules(df: DataFrame, rules: Iterable[Mapping[str, object]], id_col: str = "id") -> DataFrame:
    """Apply the enabled rules of one connector in ascending priority.

    A rule has ``rule_type``, ``column_name``, ``priority``, ``enabled`` and ``rule_config`` (JSON text or mapping):
    ``{"value"}`` for NULL_FILL, ``{"pattern", "replacement"}`` for REGEX_REPLACE, ``{"formats"}`` for DATE_NORMALIZE,
    ``{"subset", "order_by"}`` for REMOVE_DUPLICATES. A rule on an absent column is skipped.
    """
    active = sorted((r for r in rules if r.get("enabled", True)), key=lambda r: r.get("priority", 0))
    for rule in active:
        config = rule.get("rule_config") or {}
        config = json.loads(config) if isinstance(config, str) else config
        kind, column = str(rule["rule_type"]).upper(), rule.get("column_name")
        if kind == "REMOVE_DUPLICATES":
            df = dedup_exact(df, config.get("subset") or [column], config.get("order_by") or id_col)
        elif column not in df.columns:
            continue
        elif kind == "NULL_FILL":
            fill = F.lit(config.get("value", "")).cast(df.schema[column].dataType)
            df = df.withColumn(column, F.coalesce(F.col(column), fill))
        else:
            df = df.withColumn(column, _text_rule(kind, config, F.col(column)))
    return df
