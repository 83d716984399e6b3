"""Cleaning options.  Names and defaults are the public interface users already know."""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.functions.parse import CURRENCY_SYMBOLS, FALSE_TEXTS, TRUE_TEXTS
from millrace.operators.names import ID_TOKENS

# Target type names of ``enforce_schema``.
SCHEMA_TYPES = {
    "int": "bigint",
    "float": "double",
    "str": "string",
    "datetime": "timestamp",
    "bool": "boolean",
    "category": "category",
}


@dataclass
class CleanerConfig:
    # columns
    drop_constant_columns: bool = True
    drop_col_null_threshold: float | None = 0.97
    rename_map: dict[str, str] = field(default_factory=dict)
    enforce_schema: dict[str, str] = field(default_factory=dict)
    id_like_columns_first: bool = True
    id_keywords: tuple[str, ...] = ID_TOKENS

    # text
    remove_invisible_chars: bool = True
    collapse_internal_whitespace: bool = True
    remove_non_ascii: bool = False
    normalize_case_categoricals: str = "lower"
    categorical_synonyms: dict[str, dict[str, str]] = field(default_factory=dict)

    # reading text as typed values
    coerce_numeric: bool = True
    coerce_datetime: bool = True
    parse_percentages: bool = True
    parse_currency: bool = True
    currency_symbols: str = CURRENCY_SYMBOLS
    normalize_booleans: bool = True
    true_set: tuple[str, ...] = TRUE_TEXTS
    false_set: tuple[str, ...] = FALSE_TEXTS
    min_parse_ratio: float = 0.5  # share of values that must really parse; 0 trusts the look alone
    mixed_dates: bool = False  # read every known format, not only the best one

    # new columns
    parse_json_columns: bool = True
    json_max_expand_cols: int = 30
    split_delimiters: tuple[str, ...] = ("|", ",", ";", " - ")
    max_splits_per_col: int = 5
    split_max_avg_len: float | None = None  # do not split columns of longer texts

    # numbers
    winsorize_lower_q: float | None = 0.01
    winsorize_upper_q: float | None = 0.99
    winsorize_exclude_ids: bool = False
    clip_numeric_min: float | None = None
    clip_numeric_max: float | None = None
    positive_only_columns: tuple[str, ...] = ()
    impute_numeric: bool = True
    approx: bool = False  # one-pass sketches instead of exact quantiles

    # missing text
    impute_categorical: bool = True
    categorical_impute_value: str = "unknown"
    categorical_strategy: str = "constant"  # or "mode"

    # rows
    mark_outliers_zscore: bool = True
    zscore_threshold: float = 3.0
    dedupe: bool = True

    # Shares above which a text column counts as one of a kind (fixed values).
    numeric_share: float = 0.6
    datetime_share: float = 0.5
    percent_share: float = 0.6
    currency_share: float = 0.5
    boolean_share: float = 0.6
    json_share: float = 0.5
    compound_share: float = 0.7
    digit_share: float = 0.5

    def check(self) -> None:
        """Raise on options that can never work, before any data is read."""
        for column, kind in self.enforce_schema.items():
            if kind not in SCHEMA_TYPES:
                raise ValueError(f"unknown type {kind!r} for column {column!r}")
        if self.normalize_case_categoricals not in ("lower", "upper", "none"):
            raise ValueError(f"unknown case mode {self.normalize_case_categoricals!r}")
        if self.categorical_strategy not in ("constant", "mode"):
            raise ValueError(f"unknown imputation strategy {self.categorical_strategy!r}")
