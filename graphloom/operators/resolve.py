"""References to edges: every step gives candidates, the first that has one wins.

``refs``: ref_id, file_id, module, kind, callee_text, callee_name, receiver,
line, caller, owner (qname of the caller's class, or null), language, prefix.
``imports``: file_id, ordinal, alias, target (qname), wildcard boolean.
``symbols``: id, qname, name, kind, language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import BUILTIN, Catalog, matched
from .graph import chase

#: Receivers that stand for the caller's own class (fixed values).
SELVES = ("self", "cls", "this", "$this")
EXACT, IMPORT, FUZZY, UNRESOLVED = 3, 2, 1, 0
#: Edge kind of a reference kind; any other makes a references edge.
EDGE_KINDS = {"call": "calls", "dynamic_call": "calls", "inherit": "inherits", "implement": "implements", "decorator": "decorates", "annotation": "references", "callback": "callback"}


def edge_kind(kind: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in EDGE_KINDS.items() for x in kv])
    return F.coalesce(F.element_at(by, kind), F.lit("references"))


def absolute_module(module: Column, own: Column, level: Column, is_package: Column) -> Column:
    """A relative import's module: ``level`` dots up from ``own``; too many keep it as written."""
    parts = F.split(own, "\\.")
    keep = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    joined = F.when(module == "", base).otherwise(F.concat_ws(".", F.when(base != "", base), module))
    return F.when((level == 0) | (keep <= 0), module).otherwise(joined)


def import_map(imports: DataFrame) -> DataFrame:
    """(file_id, alias, target): the last import of an alias holds."""
    named = imports.where("NOT wildcard")
    return named.groupBy("file_id", "alias").agg(F.max_by("target", "ordinal").alias("target"))


def in_project(rows: DataFrame, qname: str, symbols: DataFrame) -> DataFrame:
    """Distinct values of ``qname`` that are a module of the project or lie in one, by any of their prefixes."""
    modules = symbols.where("kind = 'module'").select(F.col("qname").alias("__m")).distinct()
    names = rows.select(F.col(qname).alias("__q")).where(F.col(qname).isNotNull()).distinct()
    parts = F.split("__q", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return names.select("__q", F.explode(prefixes).alias("__m")).join(modules, "__m", "left_semi").select("__q").distinct()


def resolve(refs: DataFrame, imports: DataFrame, symbols: DataFrame, ancestors: DataFrame, exports: DataFrame | None = None, bindings: DataFrame | None = None, catalog: Catalog = BUILTIN) -> DataFrame:
    """ref_id, kind, caller, line, dst (null: not in the project), dst_qname, confidence, via for every reference that makes an edge.

    ``ancestors`` has id, ancestor, depth over class qnames; ``exports`` name and
    target of re-exports; ``bindings`` caller, name and type (a qname, with a
    language prefix if it is not of the project). Every step gives candidates
    by inner joins, and the first step that has one wins: a typed receiver, an
    import, the own module, self and its ancestors, wildcard imports, a name
    that only one symbol of the language has, and a guess. A call by a receiver
    whose guess is a sink is not bound by name alone. Callbacks that nothing
    binds make no edge.
    """
    by_qname = symbols.groupBy("qname").agg(F.max("id").alias("dst"))
    at = by_qname.withColumnRenamed("qname", "dst_qname")
    any_ = refs.withColumn("first", F.split_part(F.split_part("callee_text", F.lit("."), F.lit(1)), F.lit("("), F.lit(1))).withColumn("chained", F.col("callee_text").contains("("))
    any_ = any_.withColumn("star", F.concat("prefix", F.lit(":*."), "callee_name"))
    called = F.col("kind").isin("callback", "dynamic_call")
    r, back = any_.where(~called), any_.where("kind = 'callback'")
    made: list[DataFrame] = []

    def step(rank: int, rows: DataFrame, confidence: Column | int, via: str | Column | None = None, order: Column | int = 0) -> None:
        """Candidates of a step from rows of ref_id, dst and dst_qname; of several of one reference the least ``order``, then qname."""
        lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        made.append(rows.select("ref_id", F.lit(rank).alias("rank"), lit(order, "bigint").alias("order"), F.col("dst").cast("bigint").alias("dst"), "dst_qname", lit(confidence, "int").alias("confidence"), lit(via, "string").alias("via")))

    none = F.lit(None).cast("bigint")
    sink_guess = matched(catalog.sinks, F.col("star"), F.col("arg_preview") if "arg_preview" in refs.columns else F.lit(None).cast("string")).isNotNull()

    if bindings is not None:
        typed = r.where(F.col("receiver").isNotNull() & ~F.col("receiver").contains(".")).join(bindings.select("caller", F.col("name").alias("receiver"), "type"), ["caller", "receiver"])
        typed = typed.withColumn("dst_qname", F.concat_ws(".", "type", "callee_name"))
        step(0, typed.where(~sink_guess).join(at, "dst_qname"), IMPORT, "binding")
        step(0, typed.where(F.col("type").contains(":")).withColumn("dst", none), IMPORT, "binding", 1)

    m = import_map(imports).select("file_id", F.col("alias").alias("first"), F.col("target").alias("i_target"))
    named = r.where("NOT chained").join(m, ["file_id", "first"]).withColumn("dst_qname", F.concat("i_target", F.expr("substring(callee_text, length(first) + 1)")))
    inside = in_project(named, "dst_qname", symbols).withColumn("own", F.lit(True))
    named = named.join(inside, named["dst_qname"] == inside["__q"], "left").select("ref_id", "prefix", "dst_qname", F.coalesce("own", F.lit(False)).alias("own"))
    step(1, named.where("own").join(at, "dst_qname"), IMPORT)
    if exports is not None:
        step(1, named.where("own").join(chase(exports).select(F.col("name").alias("dst_qname"), "target"), "dst_qname").select("ref_id", F.col("target").alias("dst_qname")).join(at, "dst_qname"), IMPORT, "reexport", 1)
    step(1, named.where("own").withColumn("dst", none), UNRESOLVED, None, 2)
    step(1, named.where("NOT own").select("ref_id", none.alias("dst"), F.concat("prefix", F.lit(":"), "dst_qname").alias("dst_qname")), IMPORT)

    step(2, r.where("receiver IS NULL").withColumn("dst_qname", F.concat_ws(".", "module", "callee_name")).join(at, "dst_qname"), EXACT)

    classes = symbols.where("kind = 'class'").select(F.col("qname").alias("owner")).distinct()
    selves = r.where(F.col("receiver").isin(*SELVES)).join(classes, "owner", "left_semi").select("ref_id", "owner", "callee_name")
    lines = selves.select("ref_id", F.col("owner").alias("of"), "callee_name", F.lit(0).alias("depth")).unionByName(selves.join(ancestors.select(F.col("id").alias("owner"), F.col("ancestor").alias("of"), "depth"), "owner").select("ref_id", "of", "callee_name", "depth"))
    step(3, lines.withColumn("dst_qname", F.concat_ws(".", "of", "callee_name")).join(at, "dst_qname"), EXACT, None, F.col("depth"))

    stars = imports.where("wildcard").select("file_id", F.col("ordinal").alias("at"), F.col("target").alias("from"))
    step(4, r.where("receiver IS NULL").join(stars, "file_id").withColumn("dst_qname", F.concat_ws(".", "from", "callee_name")).join(at, "dst_qname"), IMPORT, None, F.col("at"))

    def alone(kinds: tuple[str, ...]) -> DataFrame:
        """Symbols of the kinds whose name is theirs alone in the language."""
        one = symbols.where(F.col("kind").isin(*kinds)).groupBy(F.col("name").alias("callee_name"), "language").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col("id").alias("dst"), F.col("qname").alias("dst_qname")), "id").alias("v"))
        return one.where("n = 1").select("callee_name", "language", "v.*")

    step(5, r.where("receiver IS NULL").join(alone(("function", "class")), ["callee_name", "language"]), FUZZY)
    step(5, r.where(F.col("receiver").isNotNull() & ~sink_guess).join(alone(("method",)), ["callee_name", "language"]), FUZZY)

    step(2, back.withColumn("dst_qname", F.concat_ws(".", "module", "callee_name")).join(at, "dst_qname"), IMPORT)
    step(3, back.join(m.withColumnRenamed("first", "callee_name"), ["file_id", "callee_name"]).withColumnRenamed("i_target", "dst_qname").join(at, "dst_qname"), IMPORT)
    step(4, back.join(alone(("function", "method")), ["callee_name", "language"]), IMPORT)

    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    best = every.groupBy("ref_id").agg(F.min_by(F.struct("dst", "dst_qname", "confidence", "via"), F.struct("rank", "order", "dst_qname")).alias("v"))
    dynamic = F.concat("prefix", F.lit(":"), F.when(F.col("callee_name").isin("<dynamic>", "<computed>"), "<dynamic>").otherwise(F.concat("callee_name", F.lit(".*"))))
    plain = F.when(F.col("receiver").isNotNull() | F.col("chained"), F.col("star")).otherwise(F.concat("prefix", F.lit(":"), "callee_text"))
    guess = F.when(F.col("kind") == "dynamic_call", F.struct(none.alias("dst"), dynamic.alias("dst_qname"), F.lit(UNRESOLVED).alias("confidence"), F.lit("dynamic").alias("via")))
    guess = guess.otherwise(F.struct(none.alias("dst"), plain.alias("dst_qname"), F.lit(UNRESOLVED).alias("confidence"), F.lit(None).cast("string").alias("via")))
    out = any_.join(best, "ref_id", "left").where((F.col("kind") != "callback") | F.col("v").isNotNull())
    return out.select("ref_id", edge_kind(F.col("kind")).alias("kind"), "caller", "line", F.coalesce("v", guess).alias("v")).select("ref_id", "kind", "caller", "line", "v.*")


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, dst, dst_qname, line, confidence: one edge for each different module that a file imports, by its first import.

    ``imports`` has file_id, ordinal, module (absolute), prefix and line. A
    module of the project that is not there keeps a null target of confidence 0.
    """
    first = imports.where("module IS NOT NULL AND module <> ''").groupBy("file_id", "module").agg(F.min_by(F.struct("prefix", "line"), "ordinal").alias("v")).select("file_id", "module", "v.*")
    inside = in_project(first, "module", symbols).withColumn("own", F.lit(True))
    known = symbols.groupBy(F.col("qname").alias("module")).agg(F.max("id").alias("id"))
    out = first.join(inside, first["module"] == inside["__q"], "left").join(known, "module", "left")
    own = F.coalesce("own", F.lit(False))
    dst = F.when(own, F.col("id"))
    return out.select("file_id", dst.alias("dst"), F.when(own, F.col("module")).otherwise(F.concat("prefix", F.lit(":"), "module")).alias("dst_qname"), "line", F.when(own & F.col("id").isNull(), UNRESOLVED).otherwise(IMPORT).alias("confidence"))


def hierarchy_edges(refs: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """ref_id, dst, confidence, via: calls by a receiver other than self that were bound by name or not at all, to all methods of related classes.

    ``edges`` is :func:`resolve`; ``candidates`` (name, language, id) is
    :func:`graph.hierarchy_candidates` by language. The target that the call
    already has is left out.
    """
    own = refs.where(F.col("receiver").isNotNull() & ~F.col("receiver").isin(*SELVES) & (F.col("kind") == "call")).select("ref_id", F.col("callee_name").alias("name"), "language")
    weak = edges.where(F.col("confidence") <= FUZZY).select("ref_id", F.col("dst").alias("primary"))
    met = own.join(weak, "ref_id").join(candidates, ["name", "language"]).where(~F.col("id").eqNullSafe(F.col("primary")))
    return met.select("ref_id", F.col("id").alias("dst"), F.lit(FUZZY).alias("confidence"), F.lit("cha").alias("via"))


def parents(symbols: DataFrame) -> DataFrame:
    """(id, parent): the symbol around each one by qname, in its own file if one is there, else that of the highest id, else its file's module."""
    s = symbols.where("kind NOT IN ('module', 'external')").select("id", "file_id", F.regexp_extract("qname", "^(.*)\\.[^.]*$", 1).alias("up"))
    of = symbols.where("kind <> 'external'").groupBy(F.col("qname").alias("up"), "file_id").agg(F.max("id").alias("near"))
    every = of.groupBy("up").agg(F.max("near").alias("far"))
    module = symbols.where("kind = 'module'").groupBy("file_id").agg(F.max("id").alias("module"))
    return s.join(of, ["up", "file_id"], "left").join(every, "up", "left").join(module, "file_id", "left").select("id", F.coalesce("near", "far", "module").alias("parent"))


def bound_handlers(hints: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(hint_id, symbol_id) of entrypoints: their handler in the same file, else anywhere, else the callback of the same file and line, else the file's module.

    ``hints`` has hint_id, file_id, handler (qname or null) and line; ``edges``
    file_id, kind, line and dst.
    """
    near = symbols.where("kind <> 'external'").groupBy("file_id", F.col("qname").alias("handler")).agg(F.max("id").alias("near"))
    far = near.groupBy("handler").agg(F.max("near").alias("far"))
    back = edges.where("kind = 'callback' AND dst IS NOT NULL").groupBy("file_id", "line").agg(F.min("dst").alias("back"))
    module = symbols.where("kind = 'module'").groupBy("file_id").agg(F.max("id").alias("module"))
    with_name = hints.where("handler IS NOT NULL").join(near, ["file_id", "handler"], "left").join(far, "handler", "left").select("hint_id", F.coalesce("near", "far").alias("named"))
    out = hints.join(with_name, "hint_id", "left").join(back, ["file_id", "line"], "left").join(module, "file_id", "left")
    return out.select("hint_id", F.coalesce("named", "back", "module").alias("symbol_id"))


def mint_externals(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(qname, name) of targets outside of the project that are no symbol yet, each once."""
    wanted = edges.where("dst IS NULL AND dst_qname IS NOT NULL").select(F.col("dst_qname").alias("qname")).distinct()
    return wanted.join(symbols.select("qname"), "qname", "left_anti").select("qname", F.regexp_extract("qname", "([^.:]*)$", 1).alias("name"))
