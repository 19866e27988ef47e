"""Registered queries: typed values, JSON, unions, sequences and nested types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import render
from tidewire.operators import discovery, types
from tidewire.plans.registry import query
from tidewire.sources import views


@query("render_json", """
select l_orderkey, l_linenumber,
       to_json({'line': {'number': l_linenumber, 'price': l_extendedprice}, 'order': l_orderkey,
                'part_ids': [l_partkey, l_suppkey], 'returned': l_returnflag = 'R',
                'status': l_linestatus})::varchar as json
from lineitem""")
def render_json(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("order"),
        F.struct(F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("number")).alias("line"),
        F.array("l_partkey", "l_suppkey").alias("part_ids"), (F.col("l_returnflag") == "R").alias("returned"))
    text = render.render_json(rows, ["status", "order", "line", "part_ids", "returned"])
    return rows.select("l_orderkey", "l_linenumber", text.alias("json"))


@query("union_select", """
select p_partkey, p_size % 4 as _d, case p_size % 4 when 0 then p_name end as text_value,
       case when p_size % 4 in (1, 2) then p_retailprice end as float_value,
       to_json(case p_size % 4 when 0 then json_object('_d', 0, 'text_value', p_name)
                               when 3 then json_object('_d', 3)
                               else json_object('_d', p_size % 4, 'float_value', p_retailprice) end)::varchar as json
from part""")
def union_select(spark, sf):
    value = render.union_select(F.col("p_size") % 4, {"text_value": ([0], F.col("p_name")),
                                                      "float_value": ([1, 2], F.col("p_retailprice"))})
    picked = views.table(spark, sf, "part").select("p_partkey", value.alias("value"))
    return picked.select("p_partkey", "value.*", F.to_json("value").alias("json"))


@query("explode_sequence", """
select doc_id, (generate_subscripts(words, 1) - 1)::int as pos, unnest(words) as item
from (select doc_id, string_split(text, ' ') as words from documents)""")
def explode_sequence(spark, sf):
    words = views.table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return render.explode_sequence(words, "words")


_EDGES_RECURSIVE = """
refs as (
  select distinct type_name, needs from (
    select concat('demo::part::T', p_partkey) as type_name, concat('demo::part::T', p_partkey // 3) as needs
    from part where p_partkey > 0
    union all
    select concat('demo::part::T', p_partkey), concat('demo::part::T', p_partkey // 5) from part where p_partkey > 0)),
closure as (
  select type_name, needs, 1 as depth from refs
  union
  select c.type_name, r.needs, c.depth + 1 from closure c join refs r on c.needs = r.type_name)"""


@query("type_dependencies", "select type_name, needs, max(depth) as depth from closure group by all", _EDGES_RECURSIVE)
def type_dependencies(spark, sf):
    return types.type_closure(views.part_type_members(views.table(spark, sf, "part")))


# Members of the example types; the other types in use are unknown.
_MEMBERS = [
    ("demo::click::Msg0", 0, "id", "int32"), ("demo::click::Msg0", 1, "timestamp", "float64"),
    ("demo::click::Msg0", 2, "name", "string"), ("demo::view::Msg1", 0, "frame_id", "string"),
    ("demo::view::Msg1", 1, "is_active", "boolean"), ("demo::purchase::Msg2", 0, "total", "uint64"),
]


@query("schema_catalog", f"""
select type_name, string_agg(kind || ' ' || member, '; ' order by pos) as members, count(member) > 0 as described
from (select distinct type_name from discovered where type_name <> '') 
left join (values {', '.join(str(row) for row in _MEMBERS)}) m(type_name, pos, member, kind) using (type_name)
group by type_name""")
def schema_catalog(spark, sf):
    members = spark.createDataFrame(_MEMBERS, "type_name string, pos int, member string, kind string")
    used = discovery.discovered(views.endpoint_events(spark, sf)).where("type_name <> ''")
    return types.schema_catalog(members, used)
