"""Column names and column order: all of it on the driver, none of it touches data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name tokens of identifier columns.
ID_TOKENS = ("id", "uuid", "guid")


def bare(name: str):
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unique_names(names: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """Suffix repeated names with ``_2``, ``_3`` … so that each is used once, whatever its case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        candidate, n = name, 2
        while candidate.lower() in used:
            candidate, n = f"{name}_{n}", n + 1
        used.add(candidate.lower())
        out.append(candidate)
    return out


def tidy_name(name: str) -> str:
    spaced = re.sub(r"[^\w\s]", "_", str(name).strip())
    return re.sub(r"\s+", "_", spaced).lower()


def tidy_names(names: Iterable[str]) -> list[str]:
    return unique_names(tidy_name(n) for n in names)


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*tidy_names(df.columns))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename, ignoring names that are absent."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def is_id_like(name: str, tokens: Sequence[str] = ID_TOKENS) -> bool:
    return any(part in tokens for part in name.lower().split("_"))


def ids_first(names: Sequence[str], tokens: Sequence[str] = ID_TOKENS) -> list[str]:
    """Identifier columns first, otherwise in the given order."""
    return sorted(names, key=lambda n: not is_id_like(n, tokens))


def reorder_columns(df: DataFrame, tokens: Sequence[str] = ID_TOKENS) -> DataFrame:
    return df.select(*(bare(n) for n in ids_first(df.columns, tokens)))
