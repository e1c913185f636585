"""Catalogs, frameworks and searches on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import patterns as P
from graphloom.operators import catalog as C
from graphloom.operators import frameworks as FW
from graphloom.operators import search as S

EDGES = "id bigint, src bigint, dst bigint, kind string, confidence int, via string, sink_id string, source_id string, arg_preview string"


def call(i, src, dst, kind="calls", confidence=3, via=None, sink=None, source=None, args="(x)"):
    return (i, src, dst, kind, confidence, via, sink, source, args)


@pytest.fixture(scope="module")
def tables(spark):
    names = {1: "app.start", 2: "app.mid", 3: "py:os.system", 4: "app.other"}
    symbols = spark.createDataFrame([(i, q) for i, q in names.items()], "id bigint, qname string")
    entrypoints = spark.createDataFrame([(7, "cli_command", 4)], "id bigint, kind string, symbol_id bigint")
    return lambda rows: (spark.createDataFrame(rows, EDGES), symbols, entrypoints)


def nodes(found):
    return [tuple(r["nodes"]) for r in found.rows.collect()]


def test_tiers_widen_until_a_path_is_found(tables):
    sink = "py.command-exec.os"
    look = lambda rows, **o: S.search(*tables(rows), source="app.start", sink_category="command_exec", **o)
    sure = look([call(1, 1, 2), call(2, 2, 3, sink=sink)])
    assert (sure.mode, nodes(sure), sure.truncated) == ("precise", [(1, 2, 3)], False)
    guess = [call(1, 1, 2, confidence=0), call(2, 2, 3, sink=sink)]
    assert (look(guess).mode, nodes(look(guess))) == ("widened", [(1, 2, 3)])
    assert nodes(look(guess, strict=True)) == [] and look(guess, strict=True).mode == "strict"
    assert nodes(look(guess, include_unresolved=True)) == [(1, 2, 3)] and look(guess, include_unresolved=True).mode == "explicit"
    cha = [call(1, 1, 2, confidence=1, via="cha"), call(2, 2, 3, sink=sink)]
    assert nodes(look(cha, include_unresolved=True)) == [] and nodes(look(cha, include_fuzzy=True)) == [(1, 2, 3)]
    back = [call(1, 1, 2, kind="callback"), call(2, 2, 3, sink=sink)]
    assert (look(back).mode, nodes(look(back))) == ("widened", [(1, 2, 3)])
    assert nodes(look([call(1, 1, 2)])) == []


def test_the_last_edge_must_be_tagged_unless_the_sink_is_named(tables):
    rows = [call(1, 1, 3), call(2, 2, 3, sink="py.command-exec.os"), call(3, 1, 2)]
    assert nodes(S.search(*tables(rows), source="app.start", sink_category="command_exec")) == [(1, 2, 3)]
    both = S.search(*tables(rows), source="app.start", sink="os.system", sink_category="command_exec")
    assert sorted(nodes(both)) == [(1, 2, 3), (1, 3)]
    row = both.rows.where(F.size("nodes") == 3).head()
    assert (row["category"], row["severity"], row["constant_args"], row["source_kind"], row["may_continue"]) == ("command_exec", "high", False, "spec", False)


def test_a_spent_budget_is_told(tables):
    rows = [call(i, 1, 2) for i in range(1, 9)] + [call(20 + i, 2, 3, sink="py.command-exec.os") for i in range(8)]
    cut = S.search(*tables(rows), source="app.start", sink_category="command_exec", budget=5, strict=True)
    assert cut.truncated and nodes(cut) == []
    whole = S.search(*tables(rows), source="app.start", sink_category="command_exec", strict=True, max_paths=1)
    assert not whole.truncated and len(nodes(whole)) == 1
    assert len(nodes(S.search(*tables(rows), source="app.start", sink_category="command_exec", max_paths=70))) == 64


def test_steps_do_not_pass_through_one_task(spark, tables, monkeypatch):
    """What is kept of a level stays in many partitions; a spent budget gives the best ends of its level."""
    rows = [call(i, 1, 100 + i) for i in range(200)] + [call(1000 + i, 100 + i, 3, sink="py.command-exec.os") for i in range(200)]
    kept, keep = [], S.reliable
    monkeypatch.setattr(S, "reliable", lambda df: kept.append(keep(df)) or kept[-1])
    look = lambda **o: S.search(*tables(rows), source="app.start", sink_category="command_exec", strict=True, **o)
    monkeypatch.setattr(S.G, "pool_size", lambda n: n)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = look(max_paths=3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(1, 100, 3), (1, 101, 3), (1, 102, 3)]
    steps = [df for df in kept if "fits" in df.columns and "edge_ids" in df.columns]
    assert nodes(whole) == want and not whole.truncated and len(steps) == 2 and all(df.rdd.getNumPartitions() > 1 for df in steps)
    cut = look(max_paths=3, budget=201)
    assert cut.truncated and nodes(cut) == want


def test_handlers_are_sources_unless_explicit_ones_are_asked_for(tables):
    rows = [call(1, 4, 3, sink="py.command-exec.os")]
    found = S.search(*tables(rows), source_category="cli_arg", sink_category="all")
    assert nodes(found) == [(4, 3)] and found.rows.head()["source_kind"] == "handler"
    assert nodes(S.search(*tables(rows), source_category="cli_arg", sink_category="all", explicit_sources=True)) == []


def test_what_is_not_there_is_an_error(tables):
    edges, symbols, entrypoints = tables([call(1, 1, 2)])
    with pytest.raises(C.UnknownCategory, match="sql"):
        S.search(edges, symbols, entrypoints, source="app.start", sink_category="sqll")
    with pytest.raises(C.UnknownCategory):
        S.search(edges, symbols, entrypoints, source_category="nothing", sink="os.system")
    with pytest.raises(S.NotFound):
        S.symbol(symbols, "app.none")
    with pytest.raises(S.NotFound):
        S.entrypoint(entrypoints, 8)
    assert S.symbol(symbols, "app.mid").head()["id"] == 2 and S.entrypoint(entrypoints, 7).head()["symbol_id"] == 4


@pytest.mark.parametrize(
    "callee, args, sink",
    [("java:ctx.lookup", "()", None), ("java:ctx.lookup", "(name)", "java.jndi"), ("js:*.exec", "(input)", None), ("py:subprocess.run", "(c)", "py.command-exec.subprocess"), ("py:os.system", None, "py.command-exec.os"), ("py:*.execute", "(q)", "py.sql-execute"), ("py:app.run", "(x)", None), (None, "(x)", None)],
)
def test_sinks_by_callee_and_arguments(spark, callee, args, sink):
    rows = [("calls", callee, args), ("references", callee, args)]
    got = C.stamped(spark.createDataFrame(rows, "kind string, dst_qname string, arg_preview string")).collect()
    assert {r["kind"]: r["sink_id"] for r in got} == {"calls": sink, "references": None}


def test_hints_mean_the_same_in_python(spark):
    texts = ["", "()", "(a + b)", "(params[:id])", "(f'x{y}')", '("#{x}")', "('md5')", "(MD5)", "(shell=True)", "(name, `ls ${x}`)", "(a, ENV['X'])", "($_GET['x'])", "(\"select \" . $x)", "(format!(\"{}\", x))", "(req.body.q)", "(md5, sha1)"]
    hints = sorted({e.hint for e in C.BUILTIN.sinks if e.hint})
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.col("t").rlike(h).alias(f"h{i}") for i, h in enumerate(hints)])
    for r in df.collect():
        assert [r[f"h{i}"] for i in range(len(hints))] == [bool(re.search(h, r["t"])) for h in hints]


def test_a_catalog_takes_additions_and_loses_what_is_disabled():
    more = C.BUILTIN.with_toml('disable = ["py.command-exec.os"]\n[[sink]]\nid = "own.run"\ncategory = "own"\ncallee = "py:own.{a,b}"\n[[source]]\nid = "own.in"\ncategory = "own_input"\ncallee = "py:own.read"\nchannel = "query"')
    assert "own" in more.categories("sinks") and more.ids("sources", "own_input") == ["own.in"]
    assert "py.command-exec.os" not in more.ids("sinks", "all") and len(more.sinks) == len(C.BUILTIN.sinks)
    assert more.sinks[-1].severity == "medium" and "own" not in C.BUILTIN.categories("sinks")
    again = more.with_more([C.Entry("own.run", "other", "py:own.c", "low")])
    assert again.ids("sinks", "other") == ["own.run"] and "own" not in again.categories("sinks")


def test_braces():
    assert P.expand_braces("a.{b, c}.{d,e}") == ["a.b.d", "a.b.e", "a.c.d", "a.c.e"]
    assert P.expand_braces("x{a{b,c},d}y") == ["xaby", "xacy", "xdy"]
    assert P.expand_braces("a{b") == ["a{b"] and P.expand_braces("a{,b}") == ["a", "ab"]


@pytest.mark.parametrize("preview, constant", [(None, True), ("", True), ("()", True), ('("a", 1)', True), ("(x)", False), ("(key='v', n=2)", True), ("([1, 2], {'a': None})", True), ("(`ls`)", True), ("(`ls ${x}`)", False), ('("a…', False), ("(f(1))", False)])
def test_constant_arguments(spark, preview, constant):
    assert spark.createDataFrame([(preview,)], "p string").select(P.constant_args(F.col("p"))).head()[0] is constant


def test_frameworks_need_their_language_and_enough_signals(spark):
    facts = [(1, "dependency", "python", "Flask"), (1, "import", "python", "flask"), (1, "import", "typescript", "express"), (1, "file", None, "x/manage.py"), (2, "import", "typescript", "express"), (2, "symbol", None, "ApplicationController")]
    present = [(1, "python"), (2, "javascript"), (2, "ruby")]
    got = {(r["repo_id"], r["framework"]): (r["confidence"], r["evidence"]) for r in FW.detected(spark, spark.createDataFrame(facts, "repo_id int, kind string, language string, value string"), spark.createDataFrame(present, "repo_id int, language string")).collect()}
    assert got == {(1, "flask"): (0.94, ["flask", "flask"]), (2, "express"): (0.7, ["express"]), (2, "rails"): (0.7, ["ApplicationController"])}
