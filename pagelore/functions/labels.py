"""Scalar expressions on labels and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short labels of the public datasets, by name prefix.
DATASETS = {"books": "books", "fb": "fb", "osm": "osm", "wiki": "wiki"}


def dataset_label(name: Column) -> Column:
    out = name
    for prefix, label in DATASETS.items():
        out = F.when(F.lower(name).startswith(prefix), label).otherwise(out)
    return out


def branch_factor(path: Column) -> Column:
    """The digits behind the last underscore of a name, its extension left out; null if there are none."""
    d = F.regexp_extract(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), r"_(\d+)$", 1)
    return F.when(d != "", d.cast("bigint"))


def dataset_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(_uint\d+)?(\.[a-z]+)?$", ""))


def workload_label(label: Column) -> Column:
    """tableN is called wN."""
    return F.regexp_replace(label, r"^table(\d+)$", "w$1")


def safe_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def safe_relative_error(estimate: Column, actual: Column) -> Column:
    """NaN where the actual value is 0."""
    return F.when(actual != 0, F.abs(estimate - actual) / F.abs(actual)).otherwise(F.lit(float("nan")))


def memory_mib(bytes_: Column) -> Column:
    return F.round(bytes_ / (1 << 20)).cast("int")
