"""Column-name normalisation (driver-side, names only)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_WORD_START = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<!^)(?=[A-Z][a-z])")


def snake_case(name: str) -> str:
    """``raceTime5K`` -> ``race_time5_k``, ``Max Heart Rate`` -> ``max_heart_rate``."""
    split = _WORD_START.sub("_", name.replace(" ", "_"))
    return re.sub("_{2,}", "_", split.lower())


def snake_columns(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename every column to snake_case, by position so duplicates survive."""
    renames = renames or {}
    return df.toDF(*[renames.get(c) or snake_case(c) for c in df.columns])
