"""The fitted cleaning plan: a small, serialisable description applied as column expressions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import parse, text
from millrace.operators import lookup, names, rows
from millrace.operators.longform import as_double, nan_to_null, number_columns, text_columns
from millrace.operators.names import bare
from millrace.plans.config import SCHEMA_TYPES, CleanerConfig
from millrace.plans.json_fields import parsed, rest
from millrace.plans.look import FILLED, Reading, delimiter_pattern, null_marks, tidy

Step = Callable[[DataFrame, "CleaningPlan"], DataFrame]

# The steps of a plan and the reported steps each of them carries out in one projection.
COVERED = {
    "clean_text": (
        "strip_whitespace",
        "remove_invisible_chars",
        "collapse_whitespace",
        "replace_na_like_values",
        "remove_non_ascii",
    ),
    "read_typed_columns": (
        "coerce_numeric_columns",
        "coerce_datetime_columns",
        "parse_percentages",
        "parse_currency",
        "normalize_booleans",
    ),
    "limit_numeric": ("winsorize_numeric", "clip_numeric_range", "enforce_positive_only"),
}
# Steps after which passing rows are counted.  The counts also end a stage of generated code:
# one stage for all steps exceeds the method size the JVM compiles and runs several times slower.
OBSERVED = (
    "read_typed_columns",
    "extract_numbers_from_text",
    "impute_categorical",
    "mark_outliers_zscore",
)
# Columns that only a later batch has pass the steps inside structs of this name, so that none changes them.
LATER = "__later_"
# Types that hold every value of a type before them.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("tinyint", "smallint", "int", "double"), ("float", "double"))
PLAIN_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")

NO_CATEGORY_TYPE = "Spark has no category type; see dictionary_encode"

REPORT_SCHEMA = (
    "step string, rows_before bigint, cols_before int, rows_after bigint, cols_after int, "
    "skipped boolean, reason string"
)


@dataclass
class CleaningPlan:
    config: CleanerConfig
    source: list[tuple[str, str]]  # (name, type) of the input columns, in order
    kept: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    sparse: list[str] = field(default_factory=list)
    readings: dict[str, Reading] = field(default_factory=dict)
    json_columns: list[str] = field(default_factory=list)
    json_fields: dict[str, list[dict]] = field(default_factory=dict)
    json_rest: dict[str, str] = field(default_factory=dict)  # column → column of what no leaf holds
    parts: dict[str, int] = field(default_factory=dict)
    numbers: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    fills: dict[str, str] = field(default_factory=dict)
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, dict] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    skipped_columns: dict[str, str] = field(default_factory=dict)  # column → step and reason
    rows_in: int = 0
    rows_filled: int = 0
    steps: list[tuple[str, Step]] = field(default_factory=list)  # the user's own, not serialised

    # ---- the steps, in their fixed order ----

    def registered(self) -> list[tuple[str, Step]]:
        own = [
            ("normalize_column_names", CleaningPlan._names),
            ("drop_empty_rows", CleaningPlan._empty_rows),
            ("drop_constant_columns", CleaningPlan._constant_columns),
            ("drop_high_null_columns", CleaningPlan._sparse_columns),
            ("clean_text", CleaningPlan._text),
            ("read_typed_columns", CleaningPlan._typed),
            ("standardize_categorical_case", CleaningPlan._case),
            ("apply_categorical_synonyms", CleaningPlan._synonyms),
            ("json_column_expansion", CleaningPlan._json),
            ("split_compound_columns", CleaningPlan._split),
            ("extract_numbers_from_text", CleaningPlan._numbers),
            ("limit_numeric", CleaningPlan._limits),
            ("impute_numeric", CleaningPlan._impute_numbers),
            ("impute_categorical", CleaningPlan._impute_text),
            ("mark_outliers_zscore", CleaningPlan._outliers),
            ("dedupe_rows", CleaningPlan._dedupe),
            ("set_category_dtype", CleaningPlan._category),
            ("rename_columns_map", CleaningPlan._rename),
            ("enforce_schema", CleaningPlan._schema),
            ("reorder_columns", CleaningPlan._reorder),
        ]
        return [(n, lambda df, plan, f=f: f(plan, df)) for n, f in own] + self.steps

    def transform(
        self,
        df: DataFrame,
        start: str | None = None,
        until: str | None = None,
        skip: tuple[str, ...] = (),
        trace: list[dict] | None = None,
    ) -> DataFrame:
        """Apply the plan lazily, by default all of it.

        ``start`` and ``until`` bound the steps (fitting works its way through them); ``trace``
        receives one report row per step.  Rows are counted while they pass the points in
        ``OBSERVED``, for any query listener.
        """
        run = uuid.uuid4().hex[:8]
        begun, rows_now = start is None, self.rows_in
        for name, step in self.registered():
            begun = begun or name == start
            if name == until:
                break
            if begun and name == "rename_columns_map":
                df = _shown(df)
            if not begun or name in skip:
                continue
            before = len(df.columns) if trace is not None else 0
            rows_before = rows_now
            if name not in self.skipped:
                df = step(df, self)
                if name in OBSERVED:
                    df = df.observe(f"{name}-{run}", F.count(F.lit(1)).alias("rows"))
                if name == "drop_empty_rows":
                    rows_now = self.rows_filled
                if name == "dedupe_rows" and self.config.dedupe:
                    rows_now = None  # only known once the result has been computed
            if trace is not None:
                row = {
                    "rows_before": rows_before,
                    "cols_before": before,
                    "rows_after": rows_now,
                    "cols_after": len(df.columns),
                    "skipped": name in self.skipped,
                    "reason": self.skipped.get(name),
                }
                if name == "json_column_expansion" and self.skipped_columns:
                    row["reason"] = "; ".join(f"{c}: {w}" for c, w in self.skipped_columns.items())
                trace += [{"step": covered, **row} for covered in COVERED.get(name, (name,))]
        return _shown(df)

    def _names(self, df: DataFrame) -> DataFrame:
        """The fitted columns in their order and types.

        What a fitted type does not hold whole stays as text in ``<column>__rest``; further columns pass
        through unchanged.
        """
        given = [n for n, _ in self.source]
        further = [n for n in df.columns if n not in given]
        if df.columns != given:
            missing = [n for n in given if n not in df.columns]
            if missing:
                raise ValueError(f"columns missing from the input: {missing}")
            df = df.select(*(bare(n) for n in [*given, *further]))
        tidy_names = names.tidy_names(given)
        df = nan_to_null(df.toDF(*tidy_names, *(f"{LATER}{i}" for i in range(len(further)))))
        casts, later = {}, []
        for n, (_, t), f in zip(tidy_names, self.source, df.schema.fields):
            kind = f.dataType.simpleString()
            if kind != t:
                casts[n] = bare(n).try_cast(t)
                if not _always_holds(kind, t):
                    later.append((f"{n}__rest", _unheld(bare(n), kind, t)))
        later += [(names.tidy_name(n), bare(f"{LATER}{i}")) for i, n in enumerate(further)]
        wrapped = {
            f"{LATER}{i}": F.when(x.isNotNull(), F.struct(x.alias(n))) for i, (n, x) in enumerate(later)
        }
        return nan_to_null(_with(df, {**casts, **wrapped}))

    def _empty_rows(self, df: DataFrame) -> DataFrame:
        """Drop rows without any value.

        The test is one flag, counted before it is filtered on.  The count keeps Catalyst from
        pushing the filter below the renamed columns: it would then derive a constraint for every
        combination of old and new names, twice as many with each column.
        """
        values = [F.when(bare(c).isNotNull(), F.lit(True)) for c in df.columns]
        flagged = df.withColumn(FILLED, F.coalesce(*values, F.lit(False)))
        counted = flagged.observe(
            f"read-{uuid.uuid4().hex[:8]}",
            F.count(F.lit(1)).alias("rows"),
            F.count_if(FILLED).alias("filled"),
        )
        return counted.where(F.col(FILLED)).drop(FILLED)

    def _constant_columns(self, df: DataFrame) -> DataFrame:
        return df.drop(*map(bare, self.constant))

    def _sparse_columns(self, df: DataFrame) -> DataFrame:
        return df.drop(*map(bare, self.sparse))

    def _text(self, df: DataFrame) -> DataFrame:
        texts = text_columns(df)
        df = _with(df, {c: tidy(self.config, bare(c)) for c in texts})
        return _with(df, {c: null_marks(self.config, bare(c)) for c in texts})

    def _typed(self, df: DataFrame) -> DataFrame:
        return _with(df, {c: r.apply(self.config, bare(c)) for c, r in self.readings.items()})

    def _case(self, df: DataFrame) -> DataFrame:
        mode = self.config.normalize_case_categoricals
        if mode == "none":
            return df
        return _with(
            df,
            {
                c: text.set_case(bare(c), mode)
                for c in text_columns(df)
                if c not in self.json_columns
            },
        )

    def _synonyms(self, df: DataFrame) -> DataFrame:
        for column, mapping in self.config.categorical_synonyms.items():
            df = lookup.apply_synonyms(df, column, mapping)
        return df

    def _json(self, df: DataFrame) -> DataFrame:
        if not self.json_fields:
            return df
        # Parsed once per row into a variant; the leaves are then read from it.  What they cannot
        # hold stays, as the whole document, in a column of its own.
        out = [bare(c) for c in df.columns if c not in self.json_fields]
        docs = dict(zip(self.json_fields, names.unique_names(["_doc"] * len(self.json_fields), df.columns)))
        df = _with(df, {d: parsed(df, c) for c, d in docs.items()})
        for column, leaves in self.json_fields.items():
            doc = bare(docs[column])
            out += [
                F.try_variant_get(doc, leaf["path"], leaf["type"]).alias(leaf["name"])
                for leaf in leaves
            ]
            out.append(rest(bare(column), doc, leaves).alias(self.json_rest[column]))
        return df.select(*out)

    def _split(self, df: DataFrame) -> DataFrame:
        if not self.parts:
            return df
        pattern = delimiter_pattern(self.config)  # the last part keeps whatever follows
        df = _with(df, {c: F.split(bare(c), pattern, n) for c, n in self.parts.items()})
        out = [bare(c) for c in df.columns if c not in self.parts]
        for column, count in self.parts.items():
            out += [F.get(bare(column), i).alias(f"{column}_part{i + 1}") for i in range(count)]
        return df.select(*out)

    def _numbers(self, df: DataFrame) -> DataFrame:
        return _with(df, {f"{c}_num": parse.first_number(bare(c)) for c in self.numbers})

    def limited(self, df: DataFrame, name: str) -> Column:
        """Winsorised, clipped and, where asked for, non-negative."""
        cfg, x = self.config, bare(name)
        if name in self.bounds:
            low, high = self.bounds[name]
            x = _between(x.cast("double"), low, high)
        x = _between(x, cfg.clip_numeric_min, cfg.clip_numeric_max)
        return _between(x, 0, None) if name in cfg.positive_only_columns else x

    def limit_value(self, name: str, value: float) -> float:
        """The same for one value on the driver."""
        cfg = self.config
        steps = [self.bounds.get(name, (None, None)), (cfg.clip_numeric_min, cfg.clip_numeric_max)]
        if name in cfg.positive_only_columns:
            steps.append((0, None))
        for low, high in steps:
            value = value if low is None else max(value, low)
            value = value if high is None else min(value, high)
        return value

    def _limits(self, df: DataFrame) -> DataFrame:
        return _with(df, {c: self.limited(df, c) for c in number_columns(df)})

    def _impute_numbers(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return _with(
            df,
            {
                c: F.coalesce(bare(c).cast("double"), F.lit(float(m)))
                for c, m in self.medians.items()
                if c in present
            },
        )

    def _impute_text(self, df: DataFrame) -> DataFrame:
        return _with(
            df, {c: F.coalesce(bare(c), F.lit(v)) for c, v in self.fills.items()}
        )

    def _outliers(self, df: DataFrame) -> DataFrame:
        limit = self.config.zscore_threshold
        flags = {}
        flag_names = names.unique_names((f"{c}_is_outlier" for c in self.moments), df.columns)
        for flag, (c, (mean, sd)) in zip(flag_names, self.moments.items()):
            far = F.abs(as_double(df, c) - F.lit(mean)) > F.lit(limit * sd)
            flags[flag] = F.coalesce(far, F.lit(False)) if sd else F.lit(False)
        return _with(df, flags)

    def _dedupe(self, df: DataFrame) -> DataFrame:
        return rows.dedupe_rows(df) if self.config.dedupe else df

    def _category(self, df: DataFrame) -> DataFrame:
        return df  # always listed in ``skipped``

    def _rename(self, df: DataFrame) -> DataFrame:
        return names.rename_columns(df, self.config.rename_map)

    def _schema(self, df: DataFrame) -> DataFrame:
        return enforce_schema(df, self.config.enforce_schema, self.levels)

    def _reorder(self, df: DataFrame) -> DataFrame:
        if not self.config.id_like_columns_first:
            return df
        return names.reorder_columns(df, self.config.id_keywords)

    # ---- what was done ----

    def report(
        self, spark: SparkSession, trace: list[dict], rows_out: int | None = None
    ) -> DataFrame:
        """A trace as a frame; ``rows_out`` fills in the rows left by de-duplication."""
        order = [part.split()[0] for part in REPORT_SCHEMA.split(",")]
        rows_ = [
            tuple(
                rows_out if k.startswith("rows_") and row[k] is None else row[k] for k in order
            )
            for row in trace
        ]
        return spark.createDataFrame(rows_, REPORT_SCHEMA)

    # ---- storage ----

    def to_json(self) -> str:
        data = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("steps",)}
        data["config"] = asdict(self.config)
        data["readings"] = {c: asdict(r) for c, r in self.readings.items()}
        return json.dumps(data)

    @classmethod
    def from_json(cls, text_: str) -> CleaningPlan:
        data = json.loads(text_)
        data["config"] = CleanerConfig(**data["config"])
        data["readings"] = {c: Reading(**r) for c, r in data["readings"].items()}
        data["source"] = [tuple(s) for s in data["source"]]
        return cls(**data)


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns) if columns else df


def _shown(df: DataFrame) -> DataFrame:
    """Columns that passed the steps inside structs, as themselves and last."""
    later = [c for c in df.columns if c.startswith(LATER)]
    if not later:
        return df
    own = [c for c in df.columns if c not in later]
    inner = [df.schema[c].dataType.fieldNames()[0] for c in later]
    shown = zip(later, inner, names.unique_names(inner, own))
    return df.select(*(bare(c) for c in own), *(bare(c).getField(i).alias(n) for c, i, n in shown))


def _always_holds(kind: str, target: str) -> bool:
    if kind == "void" or (target == "string" and kind in PLAIN_TYPES):
        return True
    return any(kind in w and target in w[w.index(kind) :] for w in WIDER if kind in w)


def _unheld(x: Column, kind: str, target: str) -> Column:
    """The value as text where it is lost or changed by the cast."""
    cast = x.try_cast(target)
    lost = cast.isNull()
    if kind in PLAIN_TYPES or kind.startswith("decimal"):
        lost = lost | ~cast.try_cast(kind).eqNullSafe(x)
    return F.when(x.isNotNull() & lost, x.cast("string"))


def _between(x: Column, low, high) -> Column:
    if low is not None:
        x = F.when(x < F.lit(low), F.lit(low)).otherwise(x)
    if high is not None:
        x = F.when(x > F.lit(high), F.lit(high)).otherwise(x)
    return x


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return _with(df, {c: _between(bare(c).cast("double"), *b) for c, b in bounds.items()})


def clip_numeric(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Clip every numeric column to one global range."""
    return _with(df, {c: _between(bare(c), low, high) for c in number_columns(df)})


def positive_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Negative values of the given numeric columns become 0."""
    numeric = set(number_columns(df))
    return _with(df, {c: _between(bare(c), 0, None) for c in columns if c in numeric})


def enforce_schema(
    df: DataFrame, wanted: dict[str, str], levels: dict[str, dict] | None = None
) -> DataFrame:
    """Cast columns to the wanted types; values that do not fit become NULL.

    ``category`` replaces the values by their dictionary codes; all values that were not there when
    the plan was fitted share the next code, unless the plan has been given codes for them (``plans.growth``).
    """
    for column, kind in wanted.items():
        if kind not in SCHEMA_TYPES:
            raise ValueError(f"unknown type {kind!r} for column {column!r}")
    present = {c: k for c, k in wanted.items() if c in df.columns}
    df = _with(
        df,
        {
            c: bare(c).try_cast("string" if k == "category" else SCHEMA_TYPES[k])
            for c, k in present.items()
        },
    )
    for column in (c for c, k in present.items() if k == "category"):
        fitted = (levels or {}).get(column)
        if fitted is None:
            table, count, size = lookup.level_table(df, column)
        else:
            table, count, size = read_levels(df.sparkSession, fitted)
        order = df.columns
        df = lookup.join_codes(df, column, table, size, "_code", unseen=count).drop(column)
        df = df.withColumnRenamed("_code", column).select(*(bare(c) for c in order))
    return df


def read_levels(spark: SparkSession, fitted: dict) -> tuple[DataFrame, int, int]:
    """The level table, its rows and its bytes."""
    parts = fitted.get("parts") or [fitted["path"]] if "values" not in fitted else []
    if parts:
        return spark.read.parquet(*parts), fitted["rows"], fitted["bytes"]
    rows_ = list(zip(fitted["values"], range(len(fitted["values"]))))
    return spark.createDataFrame(rows_, "value string, code bigint"), len(rows_), fitted["bytes"]
