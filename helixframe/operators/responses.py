"""Differences of nested responses, whatever the order of their arrays.

A value's canonical form is a hash that follows its type: of an object the hashes of its fields by name, of an array the
sorted hashes of its items (a multiset at every depth, or a set), of a leaf its type and text. All of it is one built-in
expression, so two responses are compared by comparing two hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaf(value: Column, kind: T.DataType, rewrites: dict[str, str]) -> Column:
    if isinstance(kind, T.StringType) and rewrites:
        table = F.create_map(*[F.lit(x) for pair in rewrites.items() for x in pair])
        value = F.coalesce(F.try_element_at(table, value), value)
    text = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
    return F.coalesce(F.concat(F.lit(kind.simpleString() + ":"), text), F.lit("null"))


def canonical(value: Column, kind: T.DataType, distinct: bool = False, rewrites: dict[str, str] | None = None) -> Column:
    """A hash (text) that is equal for values that differ in the order of arrays alone; distinct: in repeated items too. Null values are told apart from missing ones by their parent only.

    rewrites: strings that count as others, such as renamed identifiers.
    """
    rewrites = rewrites or {}
    again: Callable[[Column, T.DataType], Column] = lambda v, k: canonical(v, k, distinct, rewrites)
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}="), again(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        whole = F.concat(F.lit("{"), *[F.concat(x, F.lit(";")) for x in fields], F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: again(x, kind.elementType))
        items = F.array_distinct(items) if distinct else items
        whole = F.concat(F.lit("["), F.array_join(F.array_sort(items), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(value), lambda e: F.concat(again(e["key"], kind.keyType), F.lit("="), again(e["value"], kind.valueType)))
        whole = F.concat(F.lit("<"), F.array_join(F.array_sort(items), ","), F.lit(">"))
    else:
        return F.sha2(_leaf(value, kind, rewrites), 256)
    return F.when(value.isNull(), F.lit("null")).otherwise(F.sha2(whole, 256))


def leaves(value: Column, kind: T.DataType, path: str = "", rewrites: dict[str, str] | None = None) -> Column:
    """array<struct<path, value>>: every leaf with its path; array items share one path, items[]."""
    rewrites = rewrites or {}
    none = F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, T.StructType):
        inner = F.concat(*[leaves(value[f.name], f.dataType, f"{path}.{f.name}".lstrip("."), rewrites) for f in kind.fields]) if kind.fields else none
    elif isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x: leaves(x, kind.elementType, f"{path}[]", rewrites)))
    elif isinstance(kind, T.MapType):
        inner = F.flatten(F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, f"{path}<>", rewrites)))
    else:
        return F.array(F.struct(F.lit(path).alias("path"), _leaf(value, kind, rewrites).alias("value")))
    gone = F.array(F.struct(F.lit(path).alias("path"), F.lit("null").alias("value")))
    return F.when(value.isNull(), gone).otherwise(F.coalesce(inner, none))


def _both(old: DataFrame, new: DataFrame, key: str, response: str, make: Callable[[Column, T.DataType], Column]) -> DataFrame:
    a = old.select(F.col(key).alias("k"), make(F.col(response), old.schema[response].dataType).alias("a"), F.lit(True).alias("in_a"))
    b = new.select(F.col(key).alias("l"), make(F.col(response), new.schema[response].dataType).alias("b"), F.lit(True).alias("in_b"))
    return a.join(b, F.col("k").eqNullSafe(F.col("l")), "full")


def response_states(old: DataFrame, new: DataFrame, key: str = "key", response: str = "response", distinct: bool = False, rewrites: dict[str, str] | None = None) -> DataFrame:
    """(key, state): same, changed, only_old or only_new, by canonical hashes (X37). Keys are unique on either side."""
    met = _both(old, new, key, response, lambda v, k: canonical(v, k, distinct, rewrites))
    state = F.when(F.col("in_b").isNull(), "only_old").when(F.col("in_a").isNull(), "only_new").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return met.select(F.coalesce("k", "l").alias(key), state.alias("state"))


def discrepancies(states: DataFrame, queries: DataFrame, key: str = "key", query: str = "query") -> DataFrame:
    """(query, n, n_different): responses of each query, and how many of them differ."""
    told = states.join(queries.select(key, query), key)
    return told.groupBy(query).agg(F.count("*").alias("n"), F.count_if(F.col("state") != "same").alias("n_different"))


def leaf_differences(old: DataFrame, new: DataFrame, key: str = "key", response: str = "response", rewrites: dict[str, str] | None = None) -> DataFrame:
    """(key, path, value, n_old, n_new): leaves that one response has more often than the other, of responses that differ.

    Responses are compared by hash first; the leaves of those alone that differ are listed and counted.
    """
    changed = response_states(old, new, key, response, rewrites=rewrites).where("state = 'changed'").select(key)
    flat = lambda df, side: (
        df.join(changed, key, "left_semi").select(key, F.explode(leaves(F.col(response), df.schema[response].dataType, rewrites=rewrites)).alias("x"))
        .select(key, "x.path", "x.value", F.lit(1 if side == 0 else 0).alias("o"), F.lit(side).alias("n"))
    )
    both = flat(old, 0).unionByName(flat(new, 1)).groupBy(key, "path", "value").agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"))
    return both.where("n_old <> n_new")
