import pytest

from tidewire.operators import types


def members(spark, edges):
    return spark.createDataFrame([(a, i, f"m{i}", "struct", b) for i, (a, b) in enumerate(edges)] + [("Z", 0, "x", "int32", None)],
                                 "type_name string, pos int, member string, kind string, ref_type string")


def test_closure_takes_the_longest_chain(spark):
    edges = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("E", "D"), ("A", "B")]
    got = {(r.type_name, r.needs): r.depth for r in types.type_closure(members(spark, edges)).collect()}
    assert got == {("A", "B"): 1, ("B", "C"): 1, ("A", "C"): 2, ("C", "D"): 1, ("E", "D"): 1, ("B", "D"): 2, ("A", "D"): 3}


def test_a_circle_is_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        types.type_closure(members(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("X", "A")]))
    with pytest.raises(ValueError, match="circle"):
        types.type_closure(members(spark, [("A", "A")]))


def test_depth_has_no_limit(spark):
    got = {(r.type_name, r.needs): r.depth for r in types.type_closure(members(spark, [(f"T{i}", f"T{i + 1}") for i in range(100)])).collect()}
    assert got["T0", "T100"] == 100 and got["T40", "T77"] == 37 and len(got) == 5050


def test_known_pairs_are_never_joined_with_each_other(spark, monkeypatch):
    """A round takes leaps of one length only, else its work is the square of the pairs."""
    plans, keep = [], types.Scratch.keep

    def kept(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(types.Scratch, "keep", kept)
    got = types.type_closure(members(spark, [(f"T{i}", f"T{i + 1}") for i in range(9)] + [("T0", "T5")])).collect()
    assert len(got) == 45 and max(r.depth for r in got) == 9
    joined = [plan.split("Join", 1)[1] for plan in plans if "Join" in plan]
    assert joined and all(sum("Relation" in line and "depth#" in line for line in part.splitlines()) <= 1 for part in joined)


def test_no_references(spark):
    assert types.type_closure(members(spark, [])).count() == 0


def test_catalog(spark):
    used = spark.createDataFrame([("A",), ("Z",), ("U",), ("A",)], "type_name string")
    got = {r.type_name: (r.members, r.described) for r in types.schema_catalog(members(spark, [("A", "B"), ("A", "C")]), used).collect()}
    assert got == {"A": ("struct m0; struct m1", True), "Z": ("int32 x", True), "U": (None, False)}


def test_descriptions_are_read_back_as_written(spark):
    members = [("Top", 0, "id", "int32", None, None, None), ("Top", 1, "pose", "array", "float64", [2, 3], None),
               ("Top", 2, "joints", "sequence", "struct", None, "a::Joint"), ("Top", 4, "state", "enum", None, None, "State"),
               ("Top", 7, "value", "union", None, None, "Value"), ("a::Joint", 0, "name", "string", None, None, None),
               ("a::Joint", 1, "near", "array", "struct", [4], "Deep"), ("Deep", 0, "raw", "sequence", "byte", None, None),
               ("Value", 0, "_d", "int32", None, None, None), ("Value", 1, "i", "int32", None, None, None), ("Value", 2, "s", "string", None, None, None)]
    literals, labels = [("State", 0, "ON"), ("State", -1, "OFF")], [("Value", 1, "i"), ("Value", 2, "i"), ("Value", -3, "s")]
    tables = types.TypeTables(
        spark.createDataFrame(members, "type_name string, pos int, member string, kind string, elem_kind string, dims array<int>, ref_type string"),
        spark.createDataFrame(literals, "type_name string, value int, literal string"),
        spark.createDataFrame(labels, "type_name string, label int, member string"))
    texts = types.schema_texts(tables)
    top = bytes(texts.where("type_name = 'Top'").first().data).decode()
    places = [top.index(name) for name in ("struct Deep {", "struct a::Joint {", "struct Top {")]
    assert places == sorted(places) and top.endswith("};\n") and "  @id(1) float64[2][3] pose;" in top
    read = types.read_definitions(texts.where("type_name = 'Top'"))
    assert [sorted(map(tuple, t.collect()), key=repr) for t in read] == [sorted(rows, key=repr) for rows in (members, literals, labels)]
    other = spark.createDataFrame([(b"struct T {};",), (None,), (b"",)], "data binary")
    assert all(t.count() == 0 for t in types.read_definitions(other))
