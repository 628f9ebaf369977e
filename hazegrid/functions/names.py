"""Functions of feature names and registry texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid import constants as K

WINDOW_PATTERN = r"(\d+)h"


def max_window(name: Column) -> Column:
    """Largest number directly before an "h" in a feature name, 0 when there is none."""
    hits = F.regexp_extract_all(name, F.lit(WINDOW_PATTERN), F.lit(1))
    return F.coalesce(F.array_max(F.transform(hits, lambda m: m.cast("int"))), F.lit(0))


def max_window_of(names: Sequence[str]) -> int:
    """Same over the columns of a schema, at planning time."""
    return max((int(n) for name in names for n in re.findall(WINDOW_PATTERN, name)), default=0)


def default_value(name: Column) -> Column:
    low, out = F.lower(name), None
    for parts, value in K.DEFAULT_BY_NAME:
        hit = None
        for p in parts:
            hit = low.contains(p) if hit is None else hit | low.contains(p)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(K.DEFAULT_OTHER))


def default_for(name: str) -> float:
    low = name.lower()
    return next((v for parts, v in K.DEFAULT_BY_NAME if any(p in low for p in parts)), K.DEFAULT_OTHER)


def parse_best_model(description: Column) -> Column:
    """Model named in a description, in canonical spelling where known."""
    found = F.coalesce(
        *[F.nullif(F.regexp_extract(description, "(?i)" + p, 1), F.lit("")) for p in K.BEST_MODEL_PATTERNS]
    )
    return F.coalesce(_lookup(K.CANONICAL_MODELS, F.lower(found)), found)


def model_format(model: Column) -> Column:
    return F.coalesce(_lookup(K.MODEL_FORMATS, model), F.lit(K.DEFAULT_FORMAT))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map, so that ``key`` is evaluated once."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def is_feature(name: str, target: str) -> bool:
    return name != target and "aqi_" not in name


def suspicious_name(name: Column) -> Column:
    low, hit = F.lower(name), F.lit(False)
    for part in K.SUSPICIOUS_NAMES:
        hit = hit | low.contains(part)
    return hit
