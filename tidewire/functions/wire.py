"""Descriptions of payload types, and the Spark and Arrow types they decode to."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Primitive kind -> wire code, Spark type, Arrow type. Unsigned kinds are widened.
PRIMITIVES = {
    "boolean": ("u1", T.BooleanType(), pa.bool_()),
    "byte": ("u1", T.ShortType(), pa.int16()),
    "char": ("u1", T.StringType(), pa.string()),
    "int16": ("i2", T.ShortType(), pa.int16()),
    "uint16": ("u2", T.IntegerType(), pa.int32()),
    "int32": ("i4", T.IntegerType(), pa.int32()),
    "uint32": ("u4", T.LongType(), pa.int64()),
    "int64": ("i8", T.LongType(), pa.int64()),
    "uint64": ("u8", T.DecimalType(20, 0), pa.decimal128(20, 0)),
    "float32": ("f4", T.FloatType(), pa.float32()),
    "float64": ("f8", T.DoubleType(), pa.float64()),
}


class WireType:
    def spark(self) -> T.DataType:
        raise NotImplementedError

    def arrow(self) -> pa.DataType:
        raise NotImplementedError


@dataclass(frozen=True)
class Primitive(WireType):
    kind: str

    def spark(self):
        return PRIMITIVES[self.kind][1]

    def arrow(self):
        return PRIMITIVES[self.kind][2]


@dataclass(frozen=True)
class Text(WireType):
    def spark(self):
        return T.StringType()

    def arrow(self):
        return pa.string()


@dataclass(frozen=True)
class Enum(WireType):
    """Decodes to the literal, or the number as text when no literal has it."""

    literals: tuple[tuple[int, str], ...]

    def spark(self):
        return T.StringType()

    def arrow(self):
        return pa.string()


@dataclass(frozen=True)
class Sequence(WireType):
    item: WireType

    def spark(self):
        return T.ArrayType(self.item.spark())

    def arrow(self):
        return pa.list_(pa.field("element", self.item.arrow()))


@dataclass(frozen=True)
class Array(WireType):
    """Fixed size; several dimensions decode to one flat array."""

    item: WireType
    dims: tuple[int, ...]

    @property
    def length(self) -> int:
        return prod(self.dims)

    def spark(self):
        return T.ArrayType(self.item.spark())

    def arrow(self):
        return pa.list_(pa.field("element", self.item.arrow()))


@dataclass(frozen=True)
class Struct(WireType):
    fields: tuple[tuple[str, WireType], ...]

    def spark(self):
        return T.StructType([T.StructField(name, kind.spark()) for name, kind in self.fields])

    def arrow(self):
        return pa.struct([pa.field(name, kind.arrow()) for name, kind in self.fields])


@dataclass(frozen=True)
class Union(WireType):
    """Decodes to ``struct(_d, one nullable field per case)``."""

    discriminator: Primitive | Enum
    cases: tuple[tuple[tuple[int, ...], str, WireType], ...]

    def spark(self):
        return T.StructType([T.StructField("_d", T.IntegerType())] + [
            T.StructField(name, kind.spark()) for _, name, kind in self.cases])

    def arrow(self):
        return pa.struct([pa.field("_d", pa.int32())] + [
            pa.field(name, kind.arrow()) for _, name, kind in self.cases])


def struct(**fields: WireType | str) -> Struct:
    """``struct(id="int32", name=Text())``; a plain string names a primitive."""
    return Struct(tuple((name, Primitive(kind) if isinstance(kind, str) else kind)
                        for name, kind in fields.items()))


def from_tables(type_name: str, members: DataFrame, literals: DataFrame, labels: DataFrame) -> WireType:
    """Type description out of the ``type_members``, ``enum_literals`` and ``union_labels`` tables.

    Reads the named type and those it nests, one level per step: a few rows per type.
    """
    return catalog([type_name], members, literals, labels)[type_name]


def catalog(type_names: Iterable[str], members: DataFrame, literals: DataFrame, labels: DataFrame,
            skip_unknown: bool = False) -> dict[str, WireType]:
    """:func:`from_tables` of several types, read together, level by level of their nesting.

    ``skip_unknown`` leaves out types that cannot be built: described nowhere, needing such a type, or of an unknown kind.
    """
    asked = sorted(set(type_names))
    wanted, by_type = set(asked), {}
    while wanted - by_type.keys():
        names = sorted(wanted - by_type.keys())
        by_type.update({name: [] for name in names})
        for row in members.where(F.col("type_name").isin(names)).orderBy("type_name", "pos").collect():
            by_type[row["type_name"]].append(row)
            if row["ref_type"]:
                wanted.add(row["ref_type"])
    names = sorted(wanted)
    enums: dict[str, list] = {}
    for row in literals.where(F.col("type_name").isin(names)).orderBy("type_name", "value").collect():
        enums.setdefault(row["type_name"], []).append((row["value"], row["literal"]))
    cases: dict[tuple[str, str], list] = {}
    for row in labels.where(F.col("type_name").isin(names)).orderBy("type_name", "label").collect():
        cases.setdefault((row["type_name"], row["member"]), []).append(row["label"])
    out = {}
    for name in asked:
        try:
            out[name] = _build(name, by_type, enums, cases)
        except KeyError:
            if not skip_unknown:
                raise
    return out


def _build(name: str, by_type: dict[str, list], enums: dict[str, list], cases: dict) -> WireType:
    def of_kind(kind: str, ref: str | None) -> WireType:
        if kind == "string":
            return Text()
        return Primitive(kind) if kind in PRIMITIVES else _build(ref, by_type, enums, cases)

    def of_member(row) -> WireType:
        if row["kind"] == "sequence":
            return Sequence(of_kind(row["elem_kind"], row["ref_type"]))
        if row["kind"] == "array":
            return Array(of_kind(row["elem_kind"], row["ref_type"]), tuple(row["dims"]))
        return of_kind(row["kind"], row["ref_type"])

    if name in enums:
        return Enum(tuple(enums[name]))
    rows: Iterable = by_type[name]
    fields = [(row["member"], of_member(row)) for row in rows]
    if not fields:
        raise KeyError(f"no members known for type {name}")
    if fields[0][0] == "_d":
        return Union(fields[0][1], tuple(
            (tuple(cases.get((name, member), ())), member, kind) for member, kind in fields[1:]))
    return Struct(tuple(fields))
