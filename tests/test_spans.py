"""Lines in spans: against every pair, and in steps that do not grow with pairs."""

import random

import pytest

from graphloom.operators import relational as R

SPANS, POINTS = "id bigint, file_id bigint, start_line int, end_line int", "id bigint, file_id bigint, line int"


@pytest.fixture(scope="module")
def made(spark):
    """Odd spans and points: negative, empty, turned, null and repeated ones, lone lines, all lines, the ends of int."""
    rng = random.Random(5)
    spans = [(i, rng.randint(1, 3), a, a + rng.choice([0, 1, 2, 5, 31, 300])) for i, a in enumerate(rng.randint(-40, 200) for _ in range(300))]
    spans += [(400, 1, 9, 8), (401, 1, 9, 2), (402, None, 1, 9), (403, 2, None, 9), (404, 2, 1, None), (405, 3, -(2**31), 2**31 - 1), (406, 2, 7, 7), (407, 2, 7, 7), (408, 9, 1, 5), (409, 1, 2**31 - 2, 2**31 - 1)]
    points = [(1000 + i, rng.randint(1, 4), rng.randint(-50, 230)) for i in range(300)]
    points += [(2000, None, 3), (2001, 1, None), (2002, 3, 2**31 - 1), (2003, 3, -(2**31)), (2004, 2, 7), (2004, 2, 100), (2005, 1, 2**31 - 1), (None, 2, 7)]
    return spans, points, spark.createDataFrame(spans, SPANS), spark.createDataFrame(points, POINTS)


def inside(spans, points):
    whole = [s for s in spans if None not in s]
    return [(p, s) for p in points if None not in p[1:] for s in whole if p[1] == s[1] and s[2] <= p[2] <= s[3]]


def most_rows(df):
    """The most rows that any step of a query made, by its own counters."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        at = plan.pop()
        kind = at.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(at.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(at.plan())
        made = at.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        plan += [at.children().apply(i) for i in range(at.children().size())]
    return most


def crowd(spark, n):
    """``n`` points and ``n`` spans of one file: all pairs meet."""
    ids = spark.range(n)
    return ids.selectExpr("id", "id % 1 + 1 AS file_id", "CAST(7 + id % 3 AS INT) AS line"), ids.selectExpr("id", "id % 1 + 1 AS file_id", "CAST(1 + id % 2 AS INT) AS start_line", "CAST(9 + id % 2 AS INT) AS end_line")


def test_smallest_enclosing_is_brute_force(made, spark):
    spans, points, s, p = made
    want = {}
    for q, x in inside(spans, points):
        want[q[0]] = min(want.get(q[0], (2**40, 0)), (x[3] - x[2], x[0]))
    assert {tuple(r) for r in R.smallest_enclosing(p, s).collect()} == {(k, v[1]) for k, v in want.items()}
    assert R.smallest_enclosing(p, s.limit(0)).count() == R.smallest_enclosing(p.limit(0), s).count() == 0


def test_smallest_enclosing_makes_no_pairs(spark):
    assert most_rows(R.smallest_enclosing(*crowd(spark, 2000))) <= 4 * 2000


def nodes_of(df):
    """All operators of a query's plan, after it ran."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    plan = [df._jdf.queryExecution().executedPlan()]
    while plan:
        at = plan.pop()
        kind = at.getClass().getSimpleName()
        yield kind, at
        plan += [at.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [at.plan()] if kind.endswith("QueryStageExec") else []
        plan += [at.children().apply(i) for i in range(at.children().size())]


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("listed", [1, 3, 1024])
def test_contained_is_brute_force(made, monkeypatch, inclusive, listed):
    monkeypatch.setattr(R, "LISTED", listed, raising=False)
    spans, points, s, p = made
    p = p.unionByName(p.where("line = 7"))  # whole rows twice
    twice = points + [q for q in points if q[2] == 7]
    want = sorted(repr((*q, x[0], x[2], x[3])) for q, x in inside(spans, twice) if inclusive or q[2] > x[2])
    got = R.contained(p, s, inclusive)
    assert got.columns == ["id", "file_id", "line", "span_id", "start_line", "end_line"] and got.schema["start_line"].dataType == s.schema["start_line"].dataType
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert R.contained(p, s.limit(0)).count() == R.contained(p.limit(0), s).count() == 0


def test_contained_meets_by_lines_and_lists(spark):
    """No join by the file alone; every join makes rows of lists, which only the last step spells out as pairs."""
    p, s = crowd(spark, 3000)
    joins = [(at.leftKeys().size(), at.metrics().apply("numOutputRows").value()) for kind, at in nodes_of(R.contained(p, s)) if kind.endswith("JoinExec") and "NestedLoop" not in kind]
    assert joins and all(keys > 1 and rows <= 2 * 3000 for keys, rows in joins)
    assert R.contained(p, s).count() == 3000 * 3000


@pytest.mark.parametrize("gap", [-1, 0, 2, 40, 1000])
def test_nearest_preceding_is_brute_force(made, gap):
    spans, points, s, p = made
    want = {}
    for q in points:
        for x in spans:
            if None not in (*q[1:], x[1], x[3]) and x[1] == q[1] and 0 <= q[2] - x[3] <= gap:
                want[q[0]] = max(want.get(q[0], (-(2**40), 0)), (x[3], x[0]))
    assert {tuple(r) for r in R.nearest_preceding(p, s, "id", gap).collect()} == {(k, v[1]) for k, v in want.items()}


def test_nearest_preceding_makes_no_pairs(spark):
    assert most_rows(R.nearest_preceding(*crowd(spark, 2000), "id", 2)) <= 4 * 2000
