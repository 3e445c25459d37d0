"""Fingerprints that say which parts of the state are still valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.schemas import HIGH, MEDIUM, MIN_EXAMPLES, SKIP, TEXT_VERSION


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def classifier_hash() -> Column:
    return short_hash(F.lit(f"high={HIGH}|medium={MEDIUM}|min_examples={MIN_EXAMPLES}|skip={SKIP}"))


def ml_fingerprint(model: Column, dimension: Column) -> Column:
    """Changes when stored vectors or votes would; the set of labels is left out on purpose."""
    return F.concat_ws("|", F.concat(F.lit("model="), model), F.concat(F.lit("dim="), dimension.cast("string")), F.lit(TEXT_VERSION), F.concat(F.lit("clf="), classifier_hash()))


def excluded_hash(names: Column) -> Column:
    """Of an array of names, regardless of order, outer space and empty ones."""
    kept = F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return short_hash(F.array_join(F.sort_array(kept), "\n"))
