"""Rules from files: the settings of cleaning, filtering and sampling as JSON, by section."""

from __future__ import annotations

import json
from dataclasses import fields, replace
from typing import Any

from pyspark.sql import SparkSession

from textloom.operators.cleaning import CleaningRules
from textloom.operators.filtering import FilterRules
from textloom.operators.sampling import SamplerRules

#: Section of a file, and what it is read into.
SECTIONS: dict[str, Any] = {"cleaning": CleaningRules, "filtering": FilterRules, "sampling": SamplerRules}


def load_rules(spark: SparkSession, path: str) -> dict[str, Any]:
    """The rules of a JSON file, one for each section; what a file doesn't set keeps its default.

    The file is read by Spark, so it may be in any store that the cluster reads. A section or setting that isn't known, or a value of
    another kind than its default's, is an error that names it. A file that opens with a byte order mark is read as well.
    """
    [row] = spark.read.option("wholetext", True).text(path).collect()
    found = json.loads(row.value.removeprefix("\ufeff"))
    if not isinstance(found, dict) or found.keys() - SECTIONS.keys():
        raise ValueError(f"{path}: sections are {sorted(SECTIONS)}")
    return {name: _applied(kind(), found.get(name) or {}, f"{path}: {name}") for name, kind in SECTIONS.items()}


def _applied(rules: Any, values: dict[str, Any], where: str) -> Any:
    defaults = {f.name: getattr(rules, f.name) for f in fields(rules)}
    for name, value in values.items():
        if name not in defaults:
            raise ValueError(f"{where}.{name} isn't known")
        default = defaults[name]
        fits = isinstance(value, bool) if isinstance(default, bool) else isinstance(value, (int, float)) and not isinstance(value, bool) if isinstance(default, float) else type(value) is type(default)
        if not fits:
            raise ValueError(f"{where}.{name} has to be of the kind of {default!r}")
        values = values | {name: float(value) if isinstance(default, float) else value}
    return replace(rules, **values)
