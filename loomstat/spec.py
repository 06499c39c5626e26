"""Feature specification: which columns to read, how to treat them."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NUMERIC_TYPES = ("numeric", "numerical")
TYPES = (*NUMERIC_TYPES, "categorical")
ROLES = ("feature", "target")


@dataclass(frozen=True)
class Feature:
    """One configured column."""

    name: str
    source: str
    file: str
    type: str
    role: str
    drop_extrema: bool = False
    log_transform: bool = False
    unit: str = ""
    display_name: str | None = None
    map: Mapping[Any, Any] | None = None

    @property
    def is_numeric(self) -> bool:
        return self.type in NUMERIC_TYPES

    @property
    def label(self) -> str:
        return self.display_name or self.name


@dataclass(frozen=True)
class Spec:
    """The ordered list of configured columns, with the usual selections."""

    features: tuple[Feature, ...]
    key: str = "SEQN"
    sentinels: Mapping[str, list] = field(default_factory=dict)

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.features if f.is_numeric and f.role == "feature"]

    @property
    def categorical(self) -> list[str]:
        return [f.name for f in self.features if f.type == "categorical" and f.role == "feature"]

    @property
    def targets(self) -> list[str]:
        return [f.name for f in self.features if f.role == "target"]

    @property
    def log_targets(self) -> list[str]:
        return [f.name for f in self.features if f.role == "target" and f.log_transform]

    @property
    def files(self) -> list[str]:
        return sorted({f.file for f in self.features})

    @property
    def labels(self) -> dict[str, str]:
        return {f.name: f.label for f in self.features}

    @property
    def units(self) -> dict[str, str]:
        return {f.name: f.unit for f in self.features}

    def of_file(self, file: str) -> list[Feature]:
        return [f for f in self.features if f.file == file]

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """The specification as a small dimension table."""
        schema = "name string, source string, file string, type string, role string, unit string, display_name string"
        rows = [(f.name, f.source, f.file, f.type, f.role, f.unit, f.label) for f in self.features]
        return spark.createDataFrame(rows, schema)


def parse_spec(entries: Iterable[Mapping[str, Any]], key: str = "SEQN", sentinels: Mapping | None = None,
               strict: bool = False) -> Spec:
    """Build a specification from plain mappings.

    Unknown entry keys are reported as a warning, or as an error with ``strict``.
    """
    known = {f.name for f in fields(Feature)}
    parsed = []
    for entry in entries:
        unknown = sorted(set(entry) - known)
        if unknown:
            message = f"unknown keys {unknown} in the entry for {entry.get('name')!r}"
            if strict:
                raise ValueError(message)
            warnings.warn(message, stacklevel=2)
        feature = Feature(**{k: v for k, v in entry.items() if k in known})
        if feature.type not in TYPES:
            raise ValueError(f"{feature.name}: type {feature.type!r} is not one of {TYPES}")
        if feature.role not in ROLES:
            raise ValueError(f"{feature.name}: role {feature.role!r} is not one of {ROLES}")
        if feature.role == "target" and not feature.is_numeric:
            raise ValueError(f"{feature.name}: a target must be numeric")
        if feature.role == "feature" and feature.log_transform:
            warnings.warn(f"{feature.name}: log_transform applies to targets only", stacklevel=2)
        parsed.append(feature)
    names = [f.name for f in parsed]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"repeated names: {repeated}")
    if not any(f.role == "target" for f in parsed):
        raise ValueError("the specification has no target")
    return Spec(tuple(parsed), key, dict(sentinels or {}))


def load_spec(path: str, key: str = "SEQN", sentinels: Mapping | None = None, strict: bool = False, spark: SparkSession | None = None) -> Spec:
    """Read a YAML file holding a list under ``features``: a local one, or with ``spark`` one in any store that Spark reads."""
    import yaml

    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    return parse_spec(yaml.safe_load(text)["features"], key, sentinels, strict)


@dataclass(frozen=True)
class Classification:
    """Columns by kind, as found in a table's schema."""

    numeric: list[str]
    categorical: list[str]
    targets: list[str]
    unclassified: list[str]
    absent: list[str]

    def check(self) -> None:
        if self.unclassified:
            raise ValueError(f"unclassified columns: {self.unclassified}")
        if self.absent:
            raise ValueError(f"columns not in the table: {self.absent}")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """The columns (of ``among``) that exist and have a numeric type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in (among if among is not None else df.columns) if c in types and is_numeric(types[c])]


def classify(df: DataFrame, categorical: Iterable[str], targets: Iterable[str], key: str) -> Classification:
    """Split a table's columns into numeric, categorical and target columns."""
    wanted_categorical, targets = list(categorical), list(targets)
    present = set(df.columns)
    cats = [c for c in wanted_categorical if c in present]
    nums = [c for c in numeric_columns(df) if c not in cats and c not in targets and c != key]
    known = {*cats, *nums, *targets, key}
    return Classification(
        numeric=nums,
        categorical=cats,
        targets=targets,
        unclassified=[c for c in df.columns if c not in known],
        absent=sorted(known - present),
    )


def unlabelled(columns: Iterable[str], labels: Mapping[str, str]) -> list[str]:
    """Columns that have no display name."""
    return [c for c in columns if c not in labels]
