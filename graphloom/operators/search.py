"""Searches from sources to sinks: who is a source, who a sink, which paths lie between, and which of them come first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import constant_args, matches_glob
from ..session import reliable
from . import graph as G
from .catalog import ALL, BUILTIN, Catalog

#: Entrypoints whose handlers are sources of a category by themselves (fixed values).
HANDLERS = {"http_input": ("http_route", "graphql_resolver"), "cli_arg": ("cli_command", "main")}
#: Steps that a search may make: so many, or so many for each edge if that is more, and so many at most.
LEAST_STEPS, STEPS_AN_EDGE, MOST_STEPS = 200_000, 200, 40_000_000


class NotFound(LookupError):
    """A symbol or entrypoint that is not there."""


@dataclass(frozen=True)
class Paths:
    """Ranked paths, whether the search ended before it had seen all, and in which mode they were found."""

    rows: DataFrame
    truncated: bool
    mode: str


def symbol_ids(symbols: DataFrame, spec: str | Sequence[str], bare: bool = False) -> DataFrame:
    """(id) of the symbols whose qname a glob, or one of several, fits.

    With ``bare``, a name that fits none, without colon and star, is looked for
    behind any language prefix.
    """
    specs = [spec] if isinstance(spec, str) else list(spec)
    found = symbols.where(F.lit(False)).select("id")
    for s in specs:
        own = symbols.where(matches_glob(F.col("qname"), s)).select("id")
        if bare and ":" not in s and "*" not in s and own.isEmpty():
            own = symbols.where(matches_glob(F.col("qname"), f"*:{s}")).select("id")
        found = found.unionByName(own)
    return found.distinct()


def symbol(symbols: DataFrame, qname: str) -> DataFrame:
    """The symbol of a qname, that of the lowest id if several have it; none is an error."""
    found = symbols.where(F.col("qname") == qname).orderBy("id").limit(1)
    if found.isEmpty():
        raise NotFound(f"no symbol {qname!r}")
    return found


def entrypoint(entrypoints: DataFrame, id_: int) -> DataFrame:
    """The entrypoint of an id; none is an error."""
    found = entrypoints.where(F.col("id") == id_).limit(1)
    if found.isEmpty():
        raise NotFound(f"no entrypoint {id_}")
    return found


def handler_kinds(category: str) -> list[str]:
    return sorted({k for c, kinds in HANDLERS.items() if category in (ALL, c) for k in kinds})


def sources(edges: DataFrame, entrypoints: DataFrame, symbols: DataFrame, catalog: Catalog, source: str | Sequence[str] | None, category: str | None, explicit: bool = False) -> DataFrame:
    """Sources of a search and how they became one; see :func:`graph.source_ids`. With ``explicit``, handlers alone are none."""
    ids = catalog.ids("sources", category) if category else []
    kinds = handler_kinds(category) if category and not explicit else []
    spec = symbol_ids(symbols, source) if source is not None else symbols.select("id").limit(0)
    return G.source_ids(edges, entrypoints, spec, ids, kinds)


def bounded_paths(starts: DataFrame, sinks: DataFrame, edges: DataFrame, max_depth: int, cap: int, tagged: Column | None = None, open_sinks: DataFrame | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """(paths, truncated): the ``cap`` shortest simple paths from ``starts`` (id) to the first sink on the way.

    Equal lengths go by nodes, then edges. Where ``tagged`` is given, the last
    edge must fulfil it or lead to one of ``open_sinks`` (id). The search goes
    level by level and ends at the level that fills the pool, or truncated at the
    level in which it makes more than ``budget`` steps. Rows: nodes, edge_ids, n_nodes,
    min_confidence, and the last edge's sink_id and arg_preview.
    """
    if budget is None:
        budget = min(MOST_STEPS, max(LEAST_STEPS, STEPS_AN_EDGE * edges.count()))
    towards = reliable(G.can_reach(sinks, edges, max_depth)).select(F.col("id").alias("dst"), "left")
    goal = sinks.select(F.col("id").alias("dst")).distinct().withColumn("__end", F.lit(True))
    hop = edges.where("src <> dst").join(towards, "dst").join(goal, "dst", "left")
    fits = F.lit(True) if tagged is None else tagged
    if tagged is not None and open_sinks is not None:
        hop = hop.join(open_sinks.select(F.col("id").alias("dst")).distinct().withColumn("__open", F.lit(True)), "dst", "left")
        fits = fits | F.coalesce("__open", F.lit(False))
    hop = reliable(hop.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("id").alias("edge"), "left", "confidence", "sink_id", "arg_preview", F.coalesce("__end", F.lit(False)).alias("ends"), F.coalesce(fits, F.lit(False)).alias("fits")))
    empty = F.array().cast("array<bigint>")
    frontier = starts.select(F.col("id").alias("at")).distinct().select("at", F.array("at").alias("nodes"), empty.alias("edge_ids"), F.lit(None).cast("int").alias("low"))
    found, have, steps = None, 0, 0
    columns = ("nodes", "edge_ids", F.size("nodes").alias("n_nodes"), F.col("low").alias("min_confidence"), "sink_id", "arg_preview")
    for d in range(1, max_depth + 1):
        step = frontier.join(hop, "at").where(~F.array_contains("nodes", F.col("to")) & (F.col("left") <= max_depth - d))
        step = step.select(F.col("to").alias("at"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("edge_ids", F.col("edge")).alias("edge_ids"), F.least("low", "confidence").alias("low"), "ends", "fits", "sink_id", "arg_preview")
        n = step.limit(budget - steps + 1).count()  # one task counts rows without columns; the rows themselves stay where they are
        steps += n
        step = step if steps > budget else reliable(step)  # of a level beyond the budget only the ends are looked at
        here = step.where("ends AND fits").select(*columns).orderBy("nodes", "edge_ids").limit(cap - have)
        here = reliable(here)
        have += here.count()
        found = here if found is None else found.unionByName(here)
        if steps > budget:
            return found, True
        if have >= cap or not n:
            break
        frontier = step.where("NOT ends").select("at", "nodes", "edge_ids", "low")
    return found, False


def found_paths(edges: DataFrame, symbols: DataFrame, entrypoints: DataFrame, catalog: Catalog = BUILTIN, source: str | Sequence[str] | None = None, source_category: str | None = None, sink: str | Sequence[str] | None = None, sink_category: str | None = None, max_depth: int = 25, max_paths: int = 10, kinds: Sequence[str] = ("calls",), floor: int = 1, include_cha: bool = False, include_callbacks: bool = False, explicit_sources: bool = False, budget: int | None = None) -> tuple[DataFrame, bool]:
    """One search over a fixed set of edges: the best ``max_paths`` of a pool of paths, and whether it was truncated.

    Rows: nodes, edge_ids, n_nodes, min_confidence, sink_id, category, severity,
    constant_args, source_kind, may_continue.
    """
    kinds = (*kinds, "callback") if include_callbacks else tuple(kinds)
    tags = catalog.ids("sinks", sink_category) if sink_category else []
    own = reliable(sources(edges, entrypoints, symbols, catalog, source, source_category, explicit_sources))
    named = symbol_ids(symbols, sink, bare=True) if sink is not None else symbols.select("id").limit(0)
    goals = reliable(G.sink_ids(edges, named, tags))
    graph = G.adjacency(edges, kinds, floor, include_cha)
    tagged = F.col("sink_id").isin(*tags) if sink_category else None
    paths, truncated = bounded_paths(own, goals, graph, max_depth, G.pool_size(max_paths), tagged, named, budget)
    open_ = G.open_nodes(edges, kinds, floor, include_cha)
    pool = paths.withColumn("category", catalog.value("sinks", "category", F.col("sink_id"))).withColumn("severity", catalog.value("sinks", "severity", F.col("sink_id")))
    pool = pool.withColumn("constant_args", constant_args(F.col("arg_preview"))).drop("arg_preview")
    kind = F.when(F.col("explicit"), "accessor").when(F.col("spec"), "spec").otherwise("handler")
    pool = pool.join(F.broadcast(own.select(F.col("id").alias("__first"), kind.alias("source_kind")).join(paths.select(F.col("nodes")[0].alias("__first")).distinct(), "__first", "left_semi")), F.col("nodes")[0] == F.col("__first"), "left").drop("__first")
    pool = G.may_continue(pool, open_)
    return G.ranked(pool, max_paths), truncated


def search(*tables: DataFrame, strict: bool = False, include_fuzzy: bool = False, include_unresolved: bool = False, include_callbacks: bool = False, min_confidence: int | None = None, **options) -> Paths:
    """Paths between sources and sinks; see :func:`found_paths` for ``tables`` (edges, symbols, entrypoints) and ``options``.

    With any of the five flags one search is made over the edges that they name.
    Otherwise resolved edges are tried first, then guesses by class and unresolved
    ones too, then callbacks, until a search finds paths and is not truncated. If
    none does, the widest that found any counts.
    """
    floor = min_confidence if min_confidence is not None else 0 if include_unresolved else 1
    if strict or include_fuzzy or include_unresolved or include_callbacks or min_confidence is not None:
        rows, cut = found_paths(*tables, floor=floor, include_cha=include_fuzzy, include_callbacks=include_callbacks, **options)
        return Paths(rows, cut, "strict" if strict else "explicit")
    tries: list[tuple[Paths, bool]] = []
    for mode, callbacks in (("precise", False), ("widened", False), ("widened", True)):
        wide = mode == "widened"
        rows, cut = found_paths(*tables, floor=0 if wide else 1, include_cha=wide, include_callbacks=callbacks, **options)
        rows = reliable(rows)
        tries.append((Paths(rows, cut, mode), not rows.isEmpty()))
        if tries[-1][1] and not cut:
            return tries[-1][0]
    precise, widened, deep = tries
    return next((p for p, any_ in (deep, widened, precise) if any_), deep[0])
