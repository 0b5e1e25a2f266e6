"""Array, map and struct expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def item(array: Column, index: int) -> Column:
    """Element at a 0-based index; NULL beyond the end."""
    return F.get(array, F.lit(index))


def size(array: Column) -> Column:
    return F.size(array)


def contains(array: Column, value) -> Column:
    return F.array_contains(array, value)


def joined(array: Column, separator: str) -> Column:
    return F.array_join(array, separator)


def map_value(entries: Column, key: str) -> Column:
    """Value of a key; NULL when absent."""
    return F.try_element_at(entries, F.lit(key))


def sorted_keys(entries: Column) -> Column:
    return F.array_sort(F.map_keys(entries))


def values_by_key(entries: Column) -> Column:
    """Values in the order of their sorted keys."""
    return F.transform(sorted_keys(entries), lambda k: F.element_at(entries, k))


def field(path: str) -> Column:
    """Struct field by dotted path."""
    return F.col(path)


def unnest(df: DataFrame, array: str, name: str, outer: bool = False) -> DataFrame:
    """One row per element; ``outer`` keeps rows with an empty or NULL array."""
    explode = F.explode_outer if outer else F.explode
    return df.withColumn(name, explode(array))


def flatten(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Select nested fields under chosen names."""
    return df.select(*[F.col(path).alias(name) for path, name in paths.items()])


def flatten_all(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every leaf field of every struct, named by its path."""
    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(*[
        F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
        for path in leaves(df.schema)
    ])
