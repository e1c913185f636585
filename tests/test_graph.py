"""Traversal on small graphs."""

from graphloom.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame(rows, "id bigint, src bigint, dst bigint, sink_id string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def paths(spark, rows, sources, sinks, depth=5, terminal=None):
    return sorted(tuple(r["nodes"]) for r in G.simple_paths(ids(spark, *sources), ids(spark, *sinks), edges(spark, rows), depth, terminal).collect())


def test_self_loop_at_the_source_makes_no_path(spark):
    rows = [(1, 1, 1, None), (2, 1, 2, None), (3, 2, 3, None), (4, 3, 1, None), (5, 3, 4, None)]
    assert paths(spark, rows, [1], [4]) == [(1, 2, 3, 4)]


def test_parallel_edges_make_two_paths(spark):
    assert paths(spark, [(1, 1, 2, None), (2, 1, 2, None)], [1], [2]) == [(1, 2), (1, 2)]


def test_search_stops_at_the_first_sink(spark):
    assert paths(spark, [(1, 1, 2, None), (2, 2, 3, None)], [1], [2, 3]) == [(1, 2)]


def test_an_untagged_arrival_is_no_path_and_ends_the_search(spark):
    from pyspark.sql import functions as F

    rows = [(1, 1, 2, None), (2, 2, 3, "x")]
    assert paths(spark, rows, [1], [2, 3], terminal=F.col("sink_id").isNotNull()) == []


def test_neighbourhood_leaves_starts_out(spark):
    rows = [(1, 1, 2, None), (2, 2, 1, None), (3, 2, 3, None)]
    got = {(r["id"], r["depth"]) for r in G.neighborhood(ids(spark, 1), edges(spark, rows), 5).collect()}
    assert got == {(2, 1), (3, 2)}


def test_chase_follows_and_drops_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")
    assert {tuple(r) for r in G.chase(e).collect()} == {("a", "c"), ("b", "c")}


def test_reachable_agrees_with_paths(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    for _ in range(4):
        rows = [(i, rng.randint(1, 9), rng.randint(1, 9), rng.choice([None, "x"])) for i in range(16)]
        sinks = [7, 8, 9]
        for depth, tagged in itertools.product((1, 3), (F.col("sink_id").isNotNull(),)):
            want = {p[0] for p in paths(spark, rows, range(1, 7), sinks, depth, tagged)}
            got = G.reachable(ids(spark, *range(1, 7)), ids(spark, *sinks), edges(spark, rows), depth, tagged)
            assert {r["id"] for r in got.collect()} == want
