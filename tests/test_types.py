"""Closures, field types and trait methods on small cases."""

import itertools
import random

from tessera.operators import types as Y


def test_closure_of_cycles(spark):
    draw = random.Random(4)
    links = {(draw.randrange(30), draw.randrange(30)) for _ in range(40)} | {(100, 101), (101, 100), (102, 102)}
    df = spark.createDataFrame([*links, *list(links)[:5], (None, 1), (1, None)], "source int, target int")
    want = set(links)
    while True:
        more = {(a, d) for (a, b), (c, d) in itertools.product(want, links) if b == c} - want
        if not more:
            break
        want |= more
    got = [tuple(r) for r in Y.closure(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert Y.closure(df.limit(0)).count() == 0 and Y.closure(df, 0).count() == len(links)


def test_field_types(spark):
    fields = [("S", "a", "a: Arc<dyn Store>"), ("S", "b", "pub b: Map<Store, Entry>"), ("S", "c", "c: usize"), ("S", "d", "d: Entry"), ("S", "d", "d: Entry"), ("S", "e", None), ("S", "f", "Store"), ("S", "g", "g: x::Store<Store>")]
    known = spark.createDataFrame([("Store",), ("Entry",), ("Store",), (None,)], "name string")
    got = Y.field_types(spark.createDataFrame(fields, "container string, name string, signature string"), known)
    assert sorted(tuple(r) for r in got.collect()) == [("S", "a", "Store"), ("S", "g", "Store")]


def test_traits_collapse_only_onto_what_implements_them(spark):
    symbols = spark.createDataFrame([(1, "save", "Store"), (2, "save", "Disk"), (3, "save", "Cloud"), (4, "save", "Wrapper"), (5, "open", "Disk"), (6, "load", None)], "id int, name string, container string")
    sees = lambda file, *owners: [(file, o) for o in owners]
    visible = spark.createDataFrame(sees("a", "Store", "Disk", "Cloud") + sees("b", "Store", "Disk", "Wrapper") + sees("c", "Disk", "Cloud") + sees("d", "Cloud"), "file_path string, owner string")
    traits = spark.createDataFrame([("Store",)], "name string")
    implements = Y.closure(spark.createDataFrame([("Disk", "Store"), ("Cloud", "Disk")], "source string, target string"))
    calls = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(itertools.product("abcd", ("save", "open", "load")))], "call_id int, file_path string, callee string")
    got = {r.call_id: (r.target, r.resolution) for r in Y.trait_calls(calls, symbols, visible, traits, implements).collect()}
    assert got == {0: (1, "trait_method"), 1: (5, "suffix"), 4: (5, "suffix"), 7: (5, "suffix"), 9: (3, "suffix")}
    assert not [r for r in Y.trait_calls(calls, symbols, visible, traits, implements, common=("save", "open")).collect()]


def test_calls_on_fields(spark):
    symbols = spark.createDataFrame([(1, "save", "Store"), (2, "load", "Store"), (3, "load", "Store")], "id int, name string, container string")
    fields = spark.createDataFrame([("S", "a", "a: Store")], "container string, name string, signature string")
    calls = [(1, "S", "self.a", "save"), (2, "S", "this.a", "save"), (3, "S", "self.a", "load"), (4, "S", "self.a.b", "save"), (5, "T", "self.a", "save"), (6, "S", "a", "save"), (7, None, None, None)]
    got = Y.field_calls(spark.createDataFrame(calls, "call_id int, container string, qualifier string, callee string"), fields, symbols, spark.createDataFrame([("Store",)], "name string"))
    assert sorted((r.call_id, r.target, r.confidence) for r in got.collect()) == [(1, 1, 0.85), (2, 1, 0.85)]
