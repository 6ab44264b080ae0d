"""The people and small-market fixtures."""

import pytest
from pyspark.sql import functions as F

from deltaloom.operators.cube import Cube, Keys, Model, Range, all_keys, no_keys

#: Ties in time, parents whose children come with the batch before, and rows without children.
DATA1 = [("k4", 5, "Ada", ["k1", "k2"]), ("k3", 10, "Ben", []), ("k2", 40, "Cleo", []), ("k1", 40, "Dov", [])]
DATA2 = [("k6", 10, "Eve", []), ("k5", 15, "Fay", []), ("k8", 45, "Gil", ["k4", "k3", "k6"]), ("k7", 45, "Hal", ["k5"]), ("k9", 45, "Ida", ["k4", "k3", "k6"])]
PEOPLE = "id string, ts long, name string, children array<string>"


def people(spark, rows):
    cube = Cube("people", spark.createDataFrame(rows, PEOPLE), "id")
    return cube.range_single("ts", "ts").range_multiple("children", "children").set_single("name", "name")


def ordered(cube, dimension, n=None, sel=None):
    return [r.dimension_key for r in Model([cube]).ordered({"people": sel or {}}, "people", dimension, n).collect()]


def test_ordered_reads_after_put_and_del(spark):
    one, two = people(spark, DATA1), spark.createDataFrame(DATA2, PEOPLE)
    assert ordered(one, "ts") == [5, 10, 40, 40]
    assert ordered(one.batch(put=two), "ts") == [5, 10, 10, 15, 40, 40, 45, 45, 45]
    assert ordered(one.batch(put=two, del_=one.df), "ts") == [10, 15, 45, 45, 45]
    assert ordered(one, "children") == ["k1", "k2", None, None, None]
    assert ordered(one, "children", -4) == [None, None, None, "k2"]
    with pytest.raises(ValueError):
        one.batch(put=one.df)


@pytest.mark.parametrize("lo,hi,want", [(14, 20, 0), (None, -2, 0), (3, 3, 1), (1, 4, 6), (5, 8, 0), (None, None, 7)])
def test_inclusive_range(spark, lo, hi, want):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([1, 1, 2, 3, 4, 4, 9])], "id int, k int")
    assert Cube("c", df, "id").range_single("k", "k").filtered({"k": Range(lo, hi)}).count() == want


def test_nulls_last_both_ways_and_null_rules(spark):
    df = spark.createDataFrame([(1, None), (2, 42), (3, 9)], "id int, age int")
    cube = Cube("people", df, "id").range_single("age", "age")
    assert ordered(cube, "age") == [9, 42, None]
    assert ordered(cube, "age", -3) == [42, 9, None]
    ids = lambda f: sorted(r.id for r in cube.filtered({"age": f}).collect())
    assert ids(Range(40)) == [1]
    assert ids(Range(42)) == [1, 2]
    assert ids(Range(42, nulls=False)) == [2]
    assert ids(no_keys()) == [1] and ids(no_keys(nulls=False)) == [] and ids(all_keys()) == [1, 2, 3]
    assert ids(Keys().change(del_=[9])) == [1, 2]


def test_text_search_with_stems(spark):
    df = spark.createDataFrame([(1, "Running the -- dogs!"), (2, "A cat"), (3, None)], "id int, t string")
    cube = Cube("c", df, "id").range_multiple_text("t", "t", lambda s: s.rstrip("s"), lambda c: F.regexp_replace(c, "s$", ""))
    assert sorted(r.id for r in cube.filtered({"t": cube.search("t", "dogs")}).collect()) == [1, 3]
    assert sorted(r.key for r in cube.keys("t").collect()) == ["A", "Running", "cat", "dog"]


def market(spark, extra=()):
    make = lambda name, ids: Cube(name, spark.createDataFrame([(x,) for x in ids], "Id string"), "Id").range_single("id", "Id")
    products = Cube("products", spark.createDataFrame([("Drink", "Bottle-O"), ("Oranges", "Vege Bin"), ("Eggplant", "Vege Bin")], "Id string, S string"), "Id").range_single("id", "Id")
    rows = [("1", "Paul", ["Drink"]), ("2", "Andy", ["Drink", "Eggplant"]), ("3", "Mary", ["Drink", "Oranges"]), ("4", "Mary", ["Eggplant"]), *extra]
    orders = Cube("orders", spark.createDataFrame(rows, "Id string, C string, P array<string>"), "Id").range_single("id", "Id")
    return Model([make("suppliers", ["Bottle-O", "Vege Bin"]), products, orders, make("customers", ["Paul", "Andy", "Mary", "Sue"])]).link("products", "suppliers", "S").link("orders", "products", "P").link("orders", "customers", "C")


def seen(model, sel):
    return {n: {r.key for r in k.collect()} for n, k in model.visible_keys(sel).items()}


def test_links_narrow_both_ways(spark):
    m = market(spark)
    everything = seen(m, {})
    assert everything["customers"] == {"Paul", "Andy", "Mary", "Sue"} and len(everything["orders"]) == 4
    three = seen(m, {"orders": {"id": Range("3")}})
    assert three == {"suppliers": {"Bottle-O", "Vege Bin"}, "products": {"Drink", "Oranges"}, "orders": {"3"}, "customers": {"Mary", "Sue"}}
    both = seen(m, {"orders": {"id": Range("3")}, "products": {"id": Range("Drink")}})
    assert both == {"suppliers": {"Bottle-O"}, "products": {"Drink"}, "orders": {"3"}, "customers": {"Mary", "Sue"}}
    drink = seen(m, {"products": {"id": Range("Drink")}})
    assert drink["orders"] == {"1", "2", "3"} and drink["customers"] == {"Paul", "Andy", "Mary", "Sue"}
    more = seen(market(spark, [("5", "Sue", ["Eggplant"])]), {"products": {"id": Range("Drink")}})
    assert more["customers"] == {"Paul", "Andy", "Mary"}


def test_context_keeps_the_link_state_and_facet_does_not(spark):
    m, sel = market(spark), {"orders": {"id": Range("3")}}
    assert {r.Id for r in m.context(sel, "orders", "id").collect()} == {"3"}
    assert {r.Id for r in m.facet(sel, "orders", "id").collect()} == {"1", "2", "3", "4"}


def test_dangling_keys_keep_a_row_and_a_second_link_is_refused(spark):
    m = market(spark, [("6", "Paul", ["Gone"])])
    assert "6" in seen(m, {"products": {"id": Range("Oranges")}})["orders"]
    with pytest.raises(ValueError):
        m.link("orders", "products", "P")


def test_a_cycle_of_links_is_iterated(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    a = Cube("a", df([(1, 1), (2, 2)], "id int, b int"), "id").range_single("id", "id")
    b = Cube("b", df([(1, 1), (2, 2)], "id int, c int"), "id")
    c = Cube("c", df([(1, 1), (2, 2)], "id int, a int"), "id")
    m = Model([a, b, c]).link("a", "b", "b").link("b", "c", "c").link("c", "a", "a")
    assert seen(m, {"a": {"id": Range(1)}}) == {"a": {1}, "b": {1}, "c": {1}}


def test_or_group_and_projection_delta(spark):
    m = market(spark)
    orders = m.cubes["orders"].range_single("who", "C").or_group("any", ["id", "who"])
    assert {r.Id for r in orders.filtered({"id": Range("2"), "who": Range(nothing=True, nulls=False)}).collect()} == {"2"}
    put, gone = m.delta({"orders": {"id": Range("1")}}, {"orders": {"id": Range("4")}}, ["orders", "products", "suppliers"])
    assert [tuple(r) for r in put.collect()] == [("4", "Eggplant", "Vege Bin")]
    assert [tuple(r) for r in gone.collect()] == [("1", "Drink", "Bottle-O")]


def test_the_filter_in_force(spark):
    cube = people(spark, DATA1)
    assert cube.filter_of({"ts": Range(5, 10)}, "ts") == (5, 10) and cube.filter_of({"ts": Range(5)}, "ts") == (5, 5) and cube.filter_of({"ts": Range(nothing=True)}, "ts") is None
    assert cube.filter_of({}, "ts") is None and cube.filter_of({"name": Keys().change(del_=["Ada"])}, "name") == (None, frozenset({"Ada"}))
    with pytest.raises(KeyError):
        cube.filter_of({}, "nothing")


def test_sets_read_in_order_of_arrival(spark):
    rows = [(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "c")]
    cube = Cube("c", spark.createDataFrame(rows, "id int, k string"), "id").set_single("k", "k")
    read = lambda **x: [(r.dimension_key, r.id) for r in cube.in_set_order("k", **x).collect()]
    assert read() == [("b", 1), ("b", 4), ("a", 2), ("c", 5), (None, 3)]
    assert read(n=3) == [("b", 1), ("b", 4), ("a", 2)] and read(n=-2) == [] and read(n=0) == []
    assert read(selection={"k": Keys(frozenset({"b", "c"}), nulls=False)}) == [("b", 1), ("b", 4), ("c", 5)]
    many = Cube("c", spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "z"]), (3, [])], "id int, k array<string>"), "id").set_multiple("k", "k")
    assert [(r.dimension_key, r.id) for r in many.in_set_order("k").collect()] == [("x", 1), ("y", 1), ("y", 2), ("z", 2), (None, 3)]


def test_links_by_a_table_of_pairs(spark):
    a = Cube("a", spark.createDataFrame([(1,), (2,), (3,)], "id int"), "id").range_single("id", "id")
    b = Cube("b", spark.createDataFrame([("x",), ("y",)], "id string"), "id").range_single("id", "id")
    pairs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (9, "y"), (2, "gone"), (None, "x")], "f int, t string")
    m = Model([a, b]).link_pairs("a", "b", pairs, "f", "t")
    assert seen(m, {"b": {"id": Range("x")}}) == {"a": {1, 2, 3}, "b": {"x"}}  # 2 has an edge to a key that is in no table
    assert seen(m, {"a": {"id": Range(1)}}) == {"a": {1}, "b": {"x"}}
    assert {tuple(r) for r in m.project({}, ["a", "b"]).collect()} == {(1, "x"), (2, "y")}
    strict = Model([a, b]).link_pairs("a", "b", pairs, "f", "t", nulls=False)
    assert seen(strict, {})["a"] == {1, 2}
