"""Typed values as JSON text, union cases and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted_keys(value: Column, kind: T.DataType) -> Column:
    """The same value with struct members in name order, at every depth."""
    if isinstance(kind, T.StructType):
        members = sorted(kind.fields, key=lambda field: field.name)
        ordered = F.struct(*[_sorted_keys(value[field.name], field.dataType).alias(field.name) for field in members])
        return F.when(value.isNotNull(), ordered)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda item: _sorted_keys(item, kind.elementType))
    return value


def render_json(df: DataFrame, columns: list[str] | None = None, *, sort_keys: bool = True,
                pretty: bool = False) -> Column:
    """JSON text of the given columns of ``df``. Members that are null are left out, as in an inactive case."""
    kind = T.StructType([df.schema[name] for name in columns or df.columns])
    if sort_keys:
        kind = T.StructType(sorted(kind.fields, key=lambda field: field.name))
    members = [(_sorted_keys(F.col(f.name), f.dataType) if sort_keys else F.col(f.name)).alias(f.name)
               for f in kind.fields]
    return F.to_json(F.struct(*members), {"pretty": "true"} if pretty else {})


def union_select(discriminator: Column, cases: dict[str, tuple[list[int], Column]]) -> Column:
    """``struct(_d, one field per case)``, only the case with the discriminator's label set."""
    return F.struct(discriminator.alias("_d"), *[
        F.when(discriminator.isin(labels), value).alias(name) for name, (labels, value) in cases.items()])


def explode_sequence(df: DataFrame, column: str) -> DataFrame:
    """One row per element with its position; an empty or missing sequence keeps one row of nulls."""
    others = [name for name in df.columns if name != column]
    return df.select(*others, F.posexplode_outer(column).alias("pos", "item"))
