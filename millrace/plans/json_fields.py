"""Which fields a JSON text column holds, found level by level as a distributed distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import looks_like_json
from millrace.operators.names import bare

_NUMERIC = {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}


def parsed(df: DataFrame, column: str) -> Column:
    """The column as a variant; text that is no JSON becomes NULL."""
    col = bare(column)
    return F.try_parse_json(F.when(looks_like_json(col), col))


def _path(keys: tuple[str, ...]) -> str | None:
    steps = []
    for key in keys:
        if "'" in key and '"' in key:
            return None  # cannot be written as a path
        quote = '"' if "'" in key else "'"
        steps.append(f"[{quote}{key}{quote}]")
    return "$" + "".join(steps)


def _leaf_type(kinds: set[str]) -> str:
    if kinds == {"BIGINT"}:
        return "bigint"
    if kinds and kinds <= _NUMERIC:
        return "double"
    if kinds == {"BOOLEAN"}:
        return "boolean"
    return "string"


def rest(text: Column, doc: Column, leaves: list[dict]) -> Column:
    """The whole text where the leaves do not hold all of it, otherwise NULL.

    That is text that is no JSON object, and objects with a key that no leaf comes from, with an
    object or a plain value where the other was expected, or with a value that its leaf's type
    cannot take.
    """
    known: dict[tuple[str, ...], set[str]] = {(): set()}
    for leaf in leaves:
        for i, key in enumerate(leaf["keys"]):
            known.setdefault(tuple(leaf["keys"][:i]), set()).add(key)
    lost = doc.isNull()
    for path, keys in known.items():
        node = F.try_variant_get(doc, _path(path), "variant")
        own = F.json_object_keys(F.to_json(node))
        there = node.isNotNull() & (~F.is_variant_null(node) | F.lit(not path))
        more = F.size(F.array_except(own, F.array(*map(F.lit, sorted(keys))))) > 0
        lost = lost | (there & (own.isNull() | more))
    for leaf in leaves:
        value = F.try_variant_get(doc, leaf["path"], "variant")
        typed = F.try_variant_get(doc, leaf["path"], leaf["type"])
        lost = lost | (value.isNotNull() & ~F.is_variant_null(value) & typed.isNull())
    return F.when(text.isNotNull() & F.coalesce(lost, F.lit(True)), text)


def find_fields(df: DataFrame, column: str, cap: int) -> list[dict] | None:
    """Leaves ``{path, name, type}`` of the objects in a column, or None if they exceed ``cap``.

    Nested objects are walked, arrays stay whole as JSON text, conflicting types become text.
    Each level is one pass that returns distinct ``(parent, key, kind)`` triples; a table whose
    objects use data values as keys is recognised by the count and never gathered.
    """
    docs = df.select(parsed(df, column).alias("v")).where(F.col("v").isNotNull())
    explode = df.sparkSession.tvf.variant_explode
    level: list[tuple[str, ...]] = [()]
    leaves: dict[tuple[str, ...], set[str]] = {}
    while level:
        sub = F.array(
            *(
                F.struct(
                    F.lit(i).alias("parent"),
                    F.try_variant_get("v", _path(p), "variant").alias("node"),
                )
                for i, p in enumerate(level)
            )
        )
        nodes = docs.select(F.inline(sub))
        kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
        seen = (
            nodes.lateralJoin(explode(F.col("node").outer()))
            .where(F.col("key").isNotNull())
            .select("parent", "key", kind.alias("kind"))
            .distinct()
        )
        budget = (cap + len(level) + 1) * 10  # ten kinds at most per key
        triples = seen.limit(budget).collect()
        deeper: dict[tuple[str, ...], None] = {}
        for parent, key, kind_name in triples:
            keys = (*level[parent], key)
            if _path(keys) is None:
                continue  # stays in the rest column
            if kind_name == "OBJECT":
                deeper[keys] = None
            else:
                leaves.setdefault(keys, set()).add(kind_name)
        if len(leaves) > cap or len(deeper) > cap or len(triples) == budget:
            return None
        level = sorted(deeper)
    fields = []
    for keys in sorted(leaves):
        kinds = leaves[keys] - {"VOID"}
        fields.append(
            {
                "path": _path(keys),
                "keys": list(keys),
                "name": f"{column}__" + ".".join(keys),
                "type": _leaf_type(kinds),
            }
        )
    return fields
