"""The catalog of sinks and sources: selection, user additions, and the marking of calls.

A catalog is a small, ordered list on the driver. Calls are marked by one
expression of literal patterns, nested by language prefix, so that marking is a
projection: no join, no shuffle, and each pattern is compiled once.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog_values import SINKS, SOURCES
from ..functions.patterns import catalog_regex, first_string_arg, prefix_of

ALL = "all"


class UnknownCategory(ValueError):
    """A category that no entry of the catalog has."""


@dataclass(frozen=True)
class Entry:
    """A pattern of the catalog; ``hint`` is what a sink's arguments must show, ``channel`` where a source's data comes from."""

    id: str
    category: str
    pattern: str
    severity: str | None = None
    hint: str | None = None
    channel: str | None = None


@dataclass(frozen=True)
class Catalog:
    """Sinks and sources in the order in which they are tried; an id that is given again takes the place of the former."""

    sinks: tuple[Entry, ...] = field(default=tuple(Entry(i, c, p, s, h) for i, c, s, p, h in SINKS))
    sources: tuple[Entry, ...] = field(default=tuple(Entry(i, c, p, channel=ch) for i, c, p, ch in SOURCES))

    def with_more(self, sinks: Iterable[Entry] = (), sources: Iterable[Entry] = (), disable: Iterable[str] = ()) -> Catalog:
        """With further entries behind those that are there, less the sinks of ``disable``."""
        off = set(disable)
        last = lambda *entries: tuple({e.id: e for e in entries}.values())
        return replace(self, sinks=last(*(s for s in self.sinks if s.id not in off), *sinks), sources=last(*self.sources, *sources))

    def with_toml(self, text: str) -> Catalog:
        """With the ``[[sink]]`` and ``[[source]]`` tables of a text (keys id, category, callee, severity, require_arg_hint, channel) and its ``disable`` list."""
        told = tomllib.loads(text)
        sinks = [Entry(r["id"], r["category"], r["callee"], r.get("severity", "medium"), r.get("require_arg_hint")) for r in told.get("sink", [])]
        sources = [Entry(r["id"], r["category"], r["callee"], channel=r.get("channel")) for r in told.get("source", [])]
        return self.with_more(sinks, sources, told.get("disable", []))

    def categories(self, of: str) -> list[str]:
        return sorted({e.category for e in getattr(self, of)})

    def ids(self, of: str, category: str) -> list[str]:
        """Ids of the ``sinks`` or ``sources`` of a category, or of all; an unknown category is an error."""
        known = self.categories(of)
        if category != ALL and category not in known:
            raise UnknownCategory(f"{category!r} is no category of {of}; there are {', '.join(known)}, and {ALL!r}")
        return [e.id for e in getattr(self, of) if category in (ALL, e.category)]

    def value(self, of: str, name: str, ids: Column) -> Column:
        """Field ``name`` of the entries with the given ids; null for an unknown id."""
        pairs = [(e.id, getattr(e, name)) for e in getattr(self, of) if getattr(e, name) is not None]
        return F.element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), ids) if pairs else F.lit(None).cast("string")


BUILTIN = Catalog()


def matched(entries: Iterable[Entry], qname: Column, preview: Column | None = None) -> Column:
    """Id of the first entry whose pattern fits a qualified name, and whose hint, if any, is found in the arguments; else null.

    Entries of the name's own language prefix come first, then those of any.
    """
    by: dict[str, list[Entry]] = {}
    for e in entries:
        prefix, colon, _ = e.pattern.partition(":")
        by.setdefault(prefix if colon else "", []).append(e)

    def first(of: list[Entry]) -> Column:
        out = F.lit(None).cast("string")
        for e in reversed(of):
            fits = qname.rlike(catalog_regex(e.pattern))
            if e.hint is not None:
                fits = fits & (F.coalesce(preview, F.lit("")).rlike(e.hint) & (F.coalesce(preview, F.lit("")) != "") if preview is not None else F.lit(False))
            out = F.when(fits, F.lit(e.id)).otherwise(out)
        return out

    any_ = by.pop("", [])
    prefix, out = prefix_of(qname), first(any_)
    for name, of in sorted(by.items()):
        out = F.when(prefix == name, first([*of, *any_])).otherwise(out)
    return out


def stamped(edges: DataFrame, catalog: Catalog = BUILTIN) -> DataFrame:
    """``edges`` with sink_id, source_id and source_key (the first string among a source's arguments), set for calls alone."""
    call, q, args = F.col("kind") == "calls", F.col("dst_qname"), F.col("arg_preview")
    sink, source = F.when(call, matched(catalog.sinks, q, args)), F.when(call, matched(catalog.sources, q))
    out = edges.drop("sink_id", "source_id", "source_key").withColumn("sink_id", sink).withColumn("source_id", source)
    return out.withColumn("source_key", F.when(F.col("source_id").isNotNull(), first_string_arg(args)))


def as_rows(spark: SparkSession, catalog: Catalog = BUILTIN) -> DataFrame:
    """The catalog as a table: kind, ord, id, category, severity, pattern, hint, channel."""
    rows = [(kind, i, e.id, e.category, e.severity, e.pattern, e.hint, e.channel) for kind, of in (("sink", catalog.sinks), ("source", catalog.sources)) for i, e in enumerate(of)]
    return spark.createDataFrame(rows, "kind string, ord int, id string, category string, severity string, pattern string, hint string, channel string")
