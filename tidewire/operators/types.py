"""Nested types: transitive dependencies and the catalog of members."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import Scratch


def type_closure(members: DataFrame) -> DataFrame:
    """Every type with every type it needs, at the length of the longest chain between them.

    Ordering by descending ``depth`` lists dependencies first. Before round r, ``known`` has the pairs with a chain of fewer than
    2^r steps and ``leaps`` those with one of exactly 2^r. A longer chain is one leap and a known rest, so a round joins leaps with
    known pairs and leaps with leaps, never known pairs with each other; chains of n types take about log n rounds however deep
    they nest. Types are numbered first, since names that begin alike are dear to sort; the names come back in the result. Tables
    are stored per round and those before are deleted. A type that needs itself, over whatever way, is an error.
    """
    scratch = Scratch(members.sparkSession, "types")
    named = scratch.keep(members.where("type_name is not null and ref_type is not null").select("type_name", "ref_type").distinct())
    every = named.select(F.col("type_name").alias("name")).unionByName(named.select(F.col("ref_type").alias("name"))).distinct()
    names = scratch.keep(every.select("name", F.monotonically_increasing_id().alias("id")))
    whose = names.select(F.col("name").alias("type_name"), F.col("id").alias("_from"))
    what = names.select(F.col("name").alias("ref_type"), F.col("id").alias("_to"))
    leaps = scratch.keep(named.join(whose, "type_name").join(what, "ref_type").select("_from", "_to"))
    scratch.drop(named)
    known, steps = scratch.keep(leaps.withColumn("depth", F.lit(1))), 1
    while True:
        if known.where("_from = _to").limit(1).count():
            raise ValueError("types nest in a circle")
        onward = leaps.select("_from", F.col("_to").alias("_over"))
        twice = scratch.keep(onward.join(leaps.withColumnRenamed("_from", "_over"), "_over").select("_from", "_to").distinct())
        scratch.drop(leaps)
        leaps, steps = twice, 2 * steps
        if not leaps.limit(1).count():
            break
        rest = known.select(F.col("_from").alias("_over"), "_to", (F.col("depth") + steps).alias("depth"))
        longer = leaps.select("_from", F.col("_to").alias("_over")).join(rest, "_over").drop("_over")
        found = known.unionByName(leaps.withColumn("depth", F.lit(steps))).unionByName(longer)
        grown = scratch.keep(found.groupBy("_from", "_to").agg(F.max("depth").alias("depth")))
        scratch.drop(known)
        known = grown
    scratch.drop(leaps)
    return known.join(whose, "_from").join(what.withColumnRenamed("ref_type", "needs"), "_to").select("type_name", "needs", "depth")


def schema_catalog(members: DataFrame, used: DataFrame) -> DataFrame:
    """One row per type in use: its ordered member list, and whether it has a description at all."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "member", "kind")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["kind"], p["member"])), "; ")
    listed = members.groupBy("type_name").agg(text.alias("members"))
    return (used.select("type_name").distinct().join(listed, "type_name", "left")
            .withColumn("described", F.col("members").isNotNull()))


# --- type descriptions as text ---------------------------------------------------------------------------------


class TypeTables(NamedTuple):
    """The tables that describe types: members (type_name, pos, member, kind, elem_kind, dims, ref_type), enum literals
    (type_name, value, literal) and union labels (type_name, label, member)."""

    members: DataFrame
    literals: DataFrame
    labels: DataFrame


_END = "\n};\n"
_REF = r"(?: ([^ <>\[\]]+))?"


def definitions(tables: TypeTables) -> DataFrame:
    """(type_name, definition): one block of text per type, members and literals a line each, from which the tables can be read again."""
    item = F.concat_ws(" ", "elem_kind", "ref_type")
    dims = F.array_join(F.transform("dims", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    kind = (F.when(F.col("kind") == "sequence", F.concat(F.lit("sequence<"), item, F.lit(">")))
            .when(F.col("kind") == "array", F.concat(item, dims)).otherwise(F.concat_ws(" ", "kind", "ref_type")))
    cases = tables.labels.groupBy("type_name", "member").agg(F.array_join(F.sort_array(F.collect_list("label")).cast("array<string>"), ", ").alias("cases"))
    case = F.coalesce(F.concat(F.lit("case "), "cases", F.lit(": ")), F.lit(""))
    line = F.concat(F.lit("  @id("), F.col("pos").cast("string"), F.lit(") "), case, kind, F.lit(" "), "member", F.lit(";"))
    structs = (tables.members.join(cases, ["type_name", "member"], "left").groupBy("type_name")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda r: r["line"]), "\n").alias("lines"),
                    F.when(F.max(F.col("member") == "_d"), "union").otherwise("struct").alias("word")))
    literal = F.concat(F.lit("  "), "literal", F.lit(" = "), F.col("value").cast("string"), F.lit(";"))
    enums = tables.literals.groupBy("type_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("value", literal.alias("line")))), lambda r: r["line"]), "\n").alias("lines"),
        F.lit("enum").alias("word"))
    text = F.concat("word", F.lit(" "), "type_name", F.lit(" {\n"), "lines", F.lit(_END))
    return structs.unionByName(enums).select("type_name", text.alias("definition"))


def schema_texts(tables: TypeTables) -> DataFrame:
    """(type_name, data): the definitions of everything a type needs, dependencies first, and its own last, as UTF-8.

    What is needed but described nowhere is left out.
    """
    texts = definitions(tables)
    needed = type_closure(tables.members).select("type_name", "needs", "depth").unionByName(
        texts.select("type_name", F.col("type_name").alias("needs"), F.lit(0).alias("depth")))
    parts = needed.join(texts.withColumnRenamed("type_name", "needs"), "needs").groupBy("type_name").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("place"), "needs", "definition"))).alias("parts"))
    # a type without a definition of its own has no schema, whatever it is said to need
    return parts.join(texts.select("type_name"), "type_name", "left_semi").select(
        "type_name", F.array_join(F.col("parts.definition"), "").cast("binary").alias("data"))


def read_definitions(schemas: DataFrame, data: str = "data", keep: Sequence[str] = ()) -> TypeTables:
    """The type tables out of schema texts, each type once (or once per value of the columns ``keep``); other text gives no rows."""
    block = schemas.select(*keep, F.explode(F.split(F.col(data).cast("string"), r"\n\};\n")).alias("block")).distinct()
    head = r"\A(struct|union|enum) (\S+) \{\n"
    lines = (block.where(F.col("block").rlike(head))
             .select(*keep, F.regexp_extract("block", head, 1).alias("word"), F.regexp_extract("block", head, 2).alias("type_name"),
                     F.explode(F.split(F.regexp_replace("block", head, ""), "\n")).alias("line")).distinct())
    literal = r"\A  (.+) = (-?\d+);\z"
    literals = lines.where((F.col("word") == "enum") & F.col("line").rlike(literal)).select(
        *keep, "type_name", F.regexp_extract("line", literal, 2).cast("int").alias("value"), F.regexp_extract("line", literal, 1).alias("literal"))
    member = r"\A  @id\((-?\d+)\) (?:case ([-\d, ]+): )?(.+) (\S+);\z"
    found = lines.where((F.col("word") != "enum") & F.col("line").rlike(member)).select(
        *keep, "type_name", *[F.regexp_extract("line", member, n).alias(name) for n, name in ((1, "pos"), (2, "cases"), (3, "text"), (4, "member"))])
    sequence, array, plain = rf"\Asequence<([^ <>]+){_REF}>\z", rf"\A([^ \[\]]+){_REF}((?:\[\d+\])+)\z", rf"\A([^ ]+){_REF}\z"
    is_sequence, is_array = F.col("text").rlike(sequence), F.col("text").rlike(array)

    def piece(n: int):
        return F.nullif(F.when(is_sequence, F.regexp_extract("text", sequence, n)).when(is_array, F.regexp_extract("text", array, n)), F.lit(""))

    kind = F.when(is_sequence, "sequence").when(is_array, "array").otherwise(F.regexp_extract("text", plain, 1))
    sizes = F.regexp_extract_all(F.regexp_extract("text", array, 3), F.lit(r"(\d+)")).cast("array<int>")
    members = found.select(
        *keep, "type_name", F.col("pos").cast("int").alias("pos"), "member", kind.alias("kind"), piece(1).alias("elem_kind"),
        F.when(is_array, sizes).alias("dims"),
        F.when(is_sequence | is_array, piece(2)).otherwise(F.nullif(F.regexp_extract("text", plain, 2), F.lit(""))).alias("ref_type"))
    labels = found.where("cases <> ''").select(*keep, "type_name", F.explode(F.split("cases", ", ").cast("array<int>")).alias("label"), "member")
    return TypeTables(members, literals, labels)
