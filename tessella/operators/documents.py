"""The nested layout: documents built from flat tables, and operators on them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_many(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str, order: list[str]) -> DataFrame:
    """The parent with an array of its child rows, sorted; no child gives an empty array."""
    fields = [*order, *(c for c in child.columns if c not in order and c != child_key)]
    kids = child.groupBy(F.col(child_key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parent.join(kids, parent[parent_key] == kids["__k"], "left").drop("__k")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def embed_one(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """The parent with its one child row as a struct."""
    one = child.select(F.col(child_key).alias("__k"), F.struct(*child.columns).alias(name))
    return parent.join(one, parent[parent_key] == one["__k"], "left").drop("__k")


def unwind(df: DataFrame, path: str, keep_empty: bool = False) -> DataFrame:
    """One row per array element; rows without elements go unless kept."""
    return df.withColumn(path, (F.explode_outer if keep_empty else F.explode)(path))


def replace_root(df: DataFrame, path: str) -> DataFrame:
    return df.select(f"{path}.*")


def ne(column: str, value) -> Column:
    """Document inequality: missing values differ from any value."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def not_in(column: str, values: list) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(values)


def all_of(array: str, values: list) -> Column:
    return F.forall(F.array(*map(F.lit, values)), lambda v: F.array_contains(F.col(array), v))


# In-document updates
def push(array: str, value: Column) -> Column:
    return F.array_append(F.col(array), value)


def pull(array: str, test) -> Column:
    return F.filter(F.col(array), lambda x: ~test(x))


def add_to_set(array: str, value: Column) -> Column:
    return F.array_union(F.col(array), F.array(value))


_STEP = re.compile(r"\.(\w+)|\[(\*)\]")
_PATH = re.compile(r"\s*\$((?:\.\w+|\[\*\])*)\s*(?:\?\s*\((.*)\))?\s*", re.DOTALL)
_TEST = re.compile(r"""\s*@((?:\.\w+)*)\s*(==|!=|<>|<=|>=|<|>)\s*(?:"([^"]*)"|(true|false)|(-?[0-9.]+))\s*""")


def _field(name: str):
    return lambda x: F.try_variant_get(x, f"$.{name}", "variant")


def _steps(values: Column, path: str) -> Column:
    """The variants that a path's steps lead to from an array of variants; [*] of a value that is no array is the value (lax mode)."""
    for name, every in _STEP.findall(path):
        if every:
            values = F.flatten(F.transform(values, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
        else:
            values = F.transform(values, _field(name))
        values = F.filter(values, lambda x: x.isNotNull())
    return values


def _test(value: Column, text: str) -> Column:
    """One comparison of a filter; false where the field is missing or of another type."""
    m = _TEST.fullmatch(text)
    if not m:
        raise ValueError(f"no comparison: {text}")
    path, op, word, truth, number = m.groups()
    kind, literal = ("string", word) if word is not None else ("boolean", truth == "true") if truth else ("double", float(number))
    got = F.try_variant_get(value, "$" + path, kind)
    typed = F.schema_of_variant(F.try_variant_get(value, "$" + path, "variant")).isin(*{"string": ["STRING"], "boolean": ["BOOLEAN"]}.get(kind, [])) if kind != "double" else got.isNotNull()
    test = {"==": got == literal, "!=": got != literal, "<>": got != literal, "<": got < literal, "<=": got <= literal, ">": got > literal, ">=": got >= literal}[op]
    return F.coalesce(typed & test, F.lit(False))


def json_path_exists(column: str, path: str) -> Column:
    """Whether a JSON text has a value at a path: fields, [*], and at its end a filter ? (...) of comparisons joined by && and ||.

    && binds tighter; parentheses within a filter and methods are not known. A text that is no JSON has no values.
    """
    m = _PATH.fullmatch(path)
    if not m:
        raise ValueError(f"no path: {path}")
    values = _steps(F.filter(F.array(F.try_parse_json(F.col(column))), lambda x: x.isNotNull()), m[1])
    if m[2] is None:
        return F.size(values) > 0

    def holds(x: Column) -> Column:
        either = F.lit(False)
        for part in m[2].split("||"):
            both = F.lit(True)
            for text in part.split("&&"):
                both = both & _test(x, text)
            either = either | both
        return either

    return F.exists(values, holds)
