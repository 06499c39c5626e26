"""Column expressions shared by the operators; all of them are built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def absent_if_nan(column: Column) -> Column:
    """NaN becomes null, so that there is one notion of a missing value."""
    return F.nanvl(column, F.lit(None).cast("double"))


def absent_if_in(column: Column, codes: Sequence[Any]) -> Column:
    """Null where the column holds one of the codes."""
    return F.when(column.isin(*codes), F.lit(None)).otherwise(column)


def lookup(column: Column, mapping: Mapping[Any, Any]) -> Column:
    """The mapped value; null for null and for values the mapping does not list."""
    entries = [(k, v) for k, v in mapping.items()]
    if not entries:
        return F.lit(None).cast("string")
    literal = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in entries))
    return F.when(column.isNotNull(), F.try_element_at(literal, column))


def level_rank(column: Column, levels: Sequence[Any]) -> Column:
    """1-based position of the value in ``levels``; null when it is not listed."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), column)
    return F.nullif(position, F.lit(0)).cast("int")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def key_hash(keys: Sequence[str], seed: int | str) -> Column:
    """A 32-bit number that depends only on the key values and the seed."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit_hash(keys: Sequence[str], seed: int | str) -> Column:
    """A number in [0, 1) that depends only on the key values and the seed."""
    return key_hash(keys, seed) / F.lit(float(2**32))


# Target transforms ---------------------------------------------------------

def to_log(column: Column, kind: str | None) -> Column:
    """``log1p`` or ``log`` of a target; ``None`` leaves it."""
    if kind is None:
        return column
    return {"log1p": F.log1p, "log": F.ln}[kind](column)


def from_log(column: Column, kind: str | None) -> Column:
    """Inverse of :func:`to_log`."""
    if kind is None:
        return column
    return {"log1p": F.expm1, "log": F.exp}[kind](column)


# Residuals -----------------------------------------------------------------

def residual(true: Column, predicted: Column, kind: str = "additive") -> Column:
    """Additive, log or relative residual; null where it is undefined."""
    if kind == "additive":
        return true - predicted
    if kind == "log":
        return F.ln(true) - F.ln(predicted)
    if kind == "relative":
        return F.try_divide(true - predicted, true)
    raise ValueError(f"unknown residual kind {kind!r}")


# Names ---------------------------------------------------------------------

def title_case(column: Column) -> Column:
    """Upper case for every letter that follows a non-letter, lower case elsewhere."""
    words = F.split(F.lower(column), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(words, F.initcap), "")


def canonical_model_name(column: Column) -> Column:
    """Trimmed, title-cased model name; plain linear regression is the baseline."""
    clean = F.lower(F.trim(column))
    return F.when(clean == "linear regression", F.lit("Baseline Linear Model")).otherwise(title_case(clean))


def model_name_of_file(column: Column, suffix: str = ".pkl") -> Column:
    """``random_forest.pkl`` → ``Random Forest``."""
    return title_case(F.replace(F.replace(column, F.lit("_"), F.lit(" ")), F.lit(suffix), F.lit("")))


# Suffix of a numeric one-hot level, and the tuned-model label.
NUMERIC_LEVEL_SUFFIX = r"_\d+(\.0)?$"
TUNED_LABEL = r"^(Tuned: .+?) \(CV="


def base_feature_name(column: Column) -> Column:
    """Source column of a transformed feature (``cat__x_2.0`` and ``num__x`` → ``x``)."""
    return (
        F.when(column.contains("cat__"),
               F.regexp_replace(F.element_at(F.split(column, "cat__"), 2), NUMERIC_LEVEL_SUFFIX, ""))
        .when(column.contains("num__"), F.element_at(F.split(column, "num__"), 2))
        .otherwise(column)
    )


def tuned_model_type(column: Column) -> Column:
    """Model part of ``Tuned: <model> (CV=<k>)``; null when the text has another form."""
    return F.nullif(F.regexp_extract(column, TUNED_LABEL, 1), F.lit(""))
