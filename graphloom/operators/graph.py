"""Traversal: neighbours, reachability, simple paths and their ranking.

Edges are (id, src, dst, kind, line, confidence, via, ...). Frontiers are
DataFrames joined with the edges level by level; nothing but the count that
ends a loop reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from .relational import usable

SEVERITY = ("critical", "high", "medium", "low")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("__dst", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("__dst")).drop("__dst")


def adjacency(edges: DataFrame, kinds: Sequence[str] = ("calls",), floor: int = 1, include_cha: bool = False) -> DataFrame:
    """Usable, resolved edges of the kinds."""
    return edges.where(F.col("dst").isNotNull() & F.col("kind").isin(*kinds) & usable(floor=floor, include_cha=include_cha))


def neighborhood(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of nodes within ``depth`` steps of ``starts`` (id), these left out even on a cycle."""
    hop = edges.select("src", "dst").distinct()
    seen = reliable(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        new = hop.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = reliable(new.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0")


def callers(target: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    return neighborhood(target, reversed_edges(edges), depth)


def callees(source: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    return neighborhood(source, edges, depth)


def can_reach(sinks: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, left): nodes from which a sink is at most ``depth`` steps away, and the least number of steps."""
    ends = sinks.select("id").distinct()
    return ends.withColumn("left", F.lit(0)).unionByName(neighborhood(ends, reversed_edges(edges), depth).withColumnRenamed("depth", "left"))


def simple_paths(sources: DataFrame, sinks: DataFrame, edges: DataFrame, max_depth: int, terminal: Column | None = None, open_nodes: DataFrame | None = None) -> DataFrame:
    """Simple paths of 1 to ``max_depth`` edges from ``sources`` to the first sink on the way: nodes, edge_ids and what the way has shown.

    A path ends at the first sink it meets, and counts only if ``terminal``
    (over the last edge's columns) holds there. Parallel edges make paths of
    their own. Only edges towards a sink that the steps left still reach are
    followed. Where the edges have them, paths carry the least confidence
    (min_confidence) and the last edge's sink_id and arg_preview; with
    ``open_nodes`` (id), may_continue tells whether one is on the path.
    """
    towards = reliable(can_reach(sinks, edges, max_depth))
    goal = sinks.select(F.col("id").alias("dst")).distinct().withColumn("__end", F.lit(True))
    keep = towards.select(F.col("id").alias("dst"), "left")
    hop = edges.where("src <> dst").join(keep, "dst").join(goal, "dst", "left")
    last = [c for c in ("sink_id", "arg_preview") if c in edges.columns]
    low = ["confidence"] if "confidence" in edges.columns else []
    hop = hop.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("id").alias("edge"), "left", *low, *last, F.coalesce("__end", F.lit(False)).alias("ends"), (terminal if terminal is not None else F.lit(True)).alias("fits"))
    frontier = sources.select(F.col("id").alias("at")).distinct()
    if open_nodes is not None:
        mark = lambda c: open_nodes.select(F.col("id").alias(c)).distinct().withColumn("open", F.lit(True))
        hop = hop.join(mark("to"), "to", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        frontier = frontier.join(mark("at"), "at", "left").withColumn("may_continue", F.coalesce("open", F.lit(False))).drop("open")
    hop = reliable(hop)
    frontier = frontier.select("*", F.array("at").alias("nodes"), F.array().cast("array<bigint>").alias("edge_ids"), *([F.lit(None).cast("int").alias("min_confidence")] if low else []))
    carried = [c for c in ("may_continue", "min_confidence") if c in frontier.columns]
    news = {"may_continue": lambda: F.col("may_continue") | F.col("open"), "min_confidence": lambda: F.least("min_confidence", "confidence")}
    found = None
    for d in range(1, max_depth + 1):
        step = frontier.join(hop, "at").where(~F.array_contains("nodes", F.col("to")) & (F.col("left") <= max_depth - d))
        step = step.select(F.col("to").alias("at"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("edge_ids", F.col("edge")).alias("edge_ids"), *[news[c]().alias(c) for c in carried], *last, "ends", "fits")
        step = reliable(step)
        here = step.where("ends AND fits").select("nodes", "edge_ids", *carried, *last)
        found = here if found is None else found.unionByName(here)
        frontier = step.where("NOT ends").select("at", "nodes", "edge_ids", *carried)
        if frontier.isEmpty():
            break
    return found


def reachable(sources: DataFrame, sinks: DataFrame, edges: DataFrame, max_depth: int = 25, terminal: Column | None = None) -> DataFrame:
    """The sources (id) from which some sink is reached in at most ``max_depth`` steps, or that are one.

    With ``terminal`` (over an edge's columns) the step into the first sink on
    the way must fulfil it, as paths must; a source that is a sink is none then.
    """
    starts = sources.select("id").distinct()
    if terminal is None:
        return starts.join(can_reach(sinks, edges, max_depth), "id", "left_semi")
    ends = sinks.select(F.col("id").alias("dst")).distinct()
    last = edges.where(terminal).join(ends, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    inner = edges.join(ends, "dst", "left_anti")  # the way itself passes no sink; a start may be one
    near = last if max_depth < 2 else last.unionByName(neighborhood(last.join(ends, last["id"] == ends["dst"], "left_anti"), reversed_edges(inner), max_depth - 1).select("id"))
    return starts.join(near, "id", "left_semi")


def described(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths with n_nodes, min_confidence (0 without edges), and the last edge's sink_id and arg_preview."""
    e = edges.select(F.col("id").alias("edge"), "confidence", "sink_id", "arg_preview")
    flat = paths.select("nodes", "edge_ids", F.posexplode("edge_ids").alias("at", "edge")).join(e, "edge")
    by = flat.groupBy("nodes", "edge_ids").agg(F.min("confidence").alias("min_confidence"), F.max_by(F.struct("sink_id", "arg_preview"), "at").alias("last"))
    return by.select("nodes", "edge_ids", F.size("nodes").alias("n_nodes"), F.coalesce("min_confidence", F.lit(0)).alias("min_confidence"), "last.sink_id", "last.arg_preview")


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for i, s in reversed(list(enumerate(SEVERITY))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict, 0).when(verdict.isNull(), 1).otherwise(2)


def ranked(paths: DataFrame, k: int, verdict: Column | None = None) -> DataFrame:
    """The ``k`` best paths: verdict, severity, confidence, length, nodes, edges."""
    v = verdict_rank(verdict if verdict is not None else F.lit(None).cast("boolean"))
    return paths.orderBy(v, severity_rank(F.col("severity")), F.desc("min_confidence"), "n_nodes", "nodes", "edge_ids").limit(k)


def pool_size(max_paths: int) -> int:
    return 1 if max_paths <= 1 else max(4 * max_paths, 64)


def open_nodes(edges: DataFrame, kinds: Sequence[str], floor: int = 1, include_cha: bool = False) -> DataFrame:
    """(id) of the nodes with a resolved edge that a search leaves out, or a dynamic one."""
    out = edges.where(F.col("dst").isNotNull() & F.col("kind").isin(*kinds) & (~usable(floor=floor, include_cha=include_cha) | F.col("via").eqNullSafe("dynamic")))
    return out.select(F.col("src").alias("id")).distinct()


def may_continue(paths: DataFrame, open_: DataFrame) -> DataFrame:
    """Paths with may_continue: whether one of ``open_`` (id) is on them."""
    hit = paths.select("edge_ids", F.explode("nodes").alias("id")).join(open_, "id", "left_semi").select("edge_ids").distinct().withColumn("__hit", F.lit(True))
    return paths.join(hit, "edge_ids", "left").withColumn("may_continue", F.coalesce("__hit", F.lit(False))).drop("__hit")


def ancestors(parents: DataFrame, depth: int = 10) -> DataFrame:
    """(id, ancestor, depth) of the closure of ``parents`` (id, parent), nearest first, cycles cut."""
    up = parents.where("parent IS NOT NULL").select(F.col("id").alias("at"), F.col("parent").alias("to")).distinct()
    seen = reliable(up.where("at <> to").select(F.col("at").alias("id"), F.col("to").alias("ancestor"), F.lit(1).alias("depth")))
    frontier = seen
    for d in range(2, depth + 1):
        new = frontier.join(up, frontier["ancestor"] == up["at"]).where("id <> to").select("id", F.col("to").alias("ancestor")).distinct()
        frontier = reliable(new.join(seen, ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def chase(exports: DataFrame, hops: int = 16) -> DataFrame:
    """(name, target): re-exports (name, target) followed to a target that is no re-export itself; cycles give none."""
    e = exports.select(F.col("name").alias("__n"), F.col("target").alias("__t"))
    at = exports.select("name", "target")
    for _ in range(hops):
        step = at.join(e, at["target"] == e["__n"], "left")
        at = reliable(step.select("name", F.coalesce("__t", "target").alias("target"), F.col("__t").isNotNull().alias("__moved")))
        if at.where("__moved").isEmpty():
            break
        at = at.drop("__moved")
    return at.select("name", "target").join(e.select("__n"), at["target"] == F.col("__n"), "left_anti")


def hierarchy_candidates(methods: DataFrame, closure: DataFrame, least: int = 2, most: int = 64, cap: int = 8) -> DataFrame:
    """(name, language, id): methods of one name and language whose owners are related, ``cap`` by id.

    ``methods`` has id, name, language, owner; ``closure`` is :func:`ancestors`
    of owners. Two owners are related if their ancestors, themselves included, meet.
    """
    key = ["name", "language"]
    sizes = methods.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).select(*key)
    own = methods.join(sizes, key)
    line = own.select(*key, "id", F.col("owner").alias("top")).unionByName(own.join(closure.select(F.col("id").alias("owner"), F.col("ancestor").alias("top")), "owner").select(*key, "id", "top"))
    shared = line.distinct().groupBy(*key, "top").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)  # at most ``most`` ids
    kept = shared.select(*key, F.explode("ids").alias("id")).distinct()
    from .relational import first_of_each

    return first_of_each(kept, key, [F.col("id")], cap)


def source_ids(edges: DataFrame, entrypoints: DataFrame, spec: DataFrame, source_ids_: list[str], kinds: list[str]) -> DataFrame:
    """Sources with how they became one: id, explicit, implicit, spec.

    Explicit: an edge of theirs reads a source of ``source_ids_``. Implicit:
    they handle an entrypoint of ``kinds`` and are not explicit. ``spec`` (id)
    was named.
    """
    no = lambda *given: [F.lit(k in given).alias(k) for k in ("explicit", "implicit", "spec")]
    read = edges.where(F.col("source_id").isin(*source_ids_)).select(F.col("src").alias("id"), *no("explicit"))
    handle = entrypoints.where(F.col("kind").isin(*kinds)).select(F.col("symbol_id").alias("id"), *no("implicit"))
    out = read.unionByName(handle).unionByName(spec.select("id", *no("spec"))).groupBy("id").agg(*[F.max(k).alias(k) for k in ("explicit", "implicit", "spec")])
    return out.withColumn("implicit", F.col("implicit") & ~F.col("explicit"))


def sink_ids(edges: DataFrame, spec: DataFrame, tagged: list[str]) -> DataFrame:
    """Ids of sinks: those named by ``spec`` (id) and the targets of edges with a tag of ``tagged``."""
    into = edges.where(F.col("sink_id").isin(*tagged) & F.col("dst").isNotNull()).select(F.col("dst").alias("id"))
    return spec.select("id").union(into).distinct()


def around(center: DataFrame, symbols: DataFrame, hops: DataFrame, most: int = 60) -> DataFrame:
    """A view of ``center`` (id): id, role (center, caller, callee), qname; the first ``most`` of each by qname, then id."""
    names = symbols.select("id", "qname")

    def some(found: DataFrame, role: str) -> DataFrame:
        return found.select("id").join(names, "id").orderBy("qname", "id").limit(most).select("id", F.lit(role).alias("role"), "qname")

    return some(center, "center").unionByName(some(callers(center, hops), "caller")).unionByName(some(callees(center, hops), "callee"))
