"""Edges by name against a plain loop."""

import random

from tessera.operators import graph as G


def test_edges_of_names_that_many_ids_share(spark):
    """Names of several ids, ids of several names and without an id, repeated calls; nothing is made distinct by id unless an id has several names."""
    draw = random.Random(8)
    calls = [(draw.choice("abcdefx") if i % 9 else None, draw.choice("abcdefx"), "CALLS", draw.randrange(3)) for i in range(400)]
    single = [(i, "abcd"[i % 4]) for i in range(40)] + [(3, "d"), (90, None)]
    several = [(1, "e"), (100, "a"), (100, "b"), (100, "e"), (None, "f"), (None, "c")]
    df = spark.createDataFrame(calls, "source_name string, target_name string, type string, line int").repartition(4)
    for symbols, shuffled in ((single, False), (single + several, True)):
        rows = spark.createDataFrame(symbols, "id long, qualified_name string").repartition(3)
        want = {(s, t, kind, line) for a, b, kind, line in calls for s, x in symbols for t, y in symbols if x is not None and x == a and y == b}
        for most in (1 << 20, 0):
            edges = G.edges_of(df, rows, most_broadcast=most)
            assert sorted(map(str, map(tuple, edges.collect()))) == sorted(map(str, want))
            plan = edges._jdf.queryExecution().optimizedPlan().toString()
            assert ("Aggregate [source#" in plan) == shuffled
    assert G.edges_of(df.limit(0), rows).count() == 0 and G.edges_of(df, rows.limit(0)).count() == 0
