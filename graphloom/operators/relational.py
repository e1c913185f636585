"""Filtered listings, joins and aggregates over the graph's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import catalog_regex, matches_glob, prefix_of

KINDS = ("module", "class", "function", "method", "variable", "constant", "interface", "struct", "property", "field", "external")
#: Rows of one list that meet another list as a whole.
LISTED = 1024


def symbols(table: DataFrame, kind: str | None = None, name: str | None = None, qname: str | None = None, include_external: bool = False, limit: int | None = None, offset: int = 0, after: tuple[str, int] | None = None) -> DataFrame:
    """Symbols by glob, in order of (qname, id); ``after`` is a keyset page. A kind that is given hides nothing else."""
    out = table
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    elif not include_external:
        out = out.where(F.col("kind") != "external")
    for c, pattern in (("name", name), ("qname", qname)):
        if pattern is not None:
            out = out.where(matches_glob(F.col(c), pattern))
    if after is not None:
        out = out.where(F.struct("qname", "id") > F.struct(F.lit(after[0]).alias("qname"), F.lit(after[1]).cast("bigint").alias("id")))
    out = out.orderBy("qname", "id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def files(table: DataFrame, language: str | None = None, path: str | None = None) -> DataFrame:
    out = table if language is None else table.where(F.col("language") == language)
    out = out if path is None else out.where(matches_glob(F.col("path"), path))
    return out.orderBy("path")


def _beside(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A left join in which rows without a key stay out of the shuffle, where they would all meet in one task."""
    new = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name != key]
    known = rows.where(F.col(key).isNotNull()).join(other, key, "left")
    return known.unionByName(rows.where(F.col(key).isNull()).select("*", *new))


def with_file(symbols_: DataFrame, files_: DataFrame) -> DataFrame:
    """Symbols with the path of their file; externals have none."""
    return _beside(symbols_, files_.select(F.col("id").alias("file_id"), "path", "language"), "file_id")


def with_parent(symbols_: DataFrame) -> DataFrame:
    return _beside(symbols_, symbols_.select(F.col("id").alias("parent_id"), F.col("qname").alias("parent_qname"), F.col("kind").alias("parent_kind")), "parent_id")


def entrypoints(table: DataFrame, symbols_: DataFrame, params: DataFrame, kind: str | None = None, framework: str | None = None, route: str | None = None, limit: int | None = None) -> DataFrame:
    """Entrypoints with their handler and parameters, by kind, framework, route (nulls first), id."""
    out = table
    for c, v in (("kind", kind), ("framework", framework)):
        if v is not None:
            out = out.where(F.col(c) == v)
    if route is not None:
        out = out.where(matches_glob(F.col("route"), route))
    s = symbols_.select(F.col("id").alias("symbol_id"), F.col("qname").alias("handler"))
    p = params.groupBy(F.col("entrypoint_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("params"))
    out = out.join(s, "symbol_id").join(p, "id", "left").withColumn("params", F.coalesce("params", F.array().cast("array<string>")))
    out = out.orderBy(F.asc_nulls_first("kind"), F.asc_nulls_first("framework"), F.asc_nulls_first("route"), "id")
    return out if limit is None else out.limit(limit)


def usable(confidence: str = "confidence", via: str = "via", floor: int = 1, include_cha: bool = False) -> Column:
    """Edges at or above a confidence, without class-hierarchy guesses unless wanted."""
    kept = F.col(confidence) >= floor
    return kept if include_cha else kept & ~F.col(via).eqNullSafe("cha")


def references(edges: DataFrame, symbols_: DataFrame, targets: DataFrame) -> DataFrame:
    """All edges into ``targets`` (id), with the referring symbol's qname, or ``?``."""
    s = symbols_.select(F.col("id").alias("src"), F.col("qname").alias("src_qname"))
    into = edges.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return into.join(s, "src", "left").withColumn("src_qname", F.coalesce("src_qname", F.lit("?")))


def stats(files_: DataFrame, symbols_: DataFrame, edges: DataFrame, entrypoints_: DataFrame) -> DataFrame:
    """Seven counts in one row, each table read once."""
    parts = [
        files_.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("what"), "n"),
        symbols_.agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols").alias("what"), "n"),
        edges.agg(F.struct(F.count(F.lit(1)).alias("edges"), F.count("dst").alias("resolved"), F.count("sink_id").alias("sinks"), F.count("source_id").alias("sources")).alias("e")).select(F.explode(F.create_map(F.lit("edges"), "e.edges", F.lit("resolved"), "e.resolved", F.lit("sinks"), "e.sinks", F.lit("sources"), "e.sources")).alias("what", "n")),
        entrypoints_.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entrypoints").alias("what"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = ("files", "symbols", "edges", "resolved", "sinks", "sources", "entrypoints")
    return out.agg(*[F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in names])


def language_profile(files_: DataFrame) -> DataFrame:
    """Files and bytes by language, with the share of all bytes."""
    by = files_.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    total = F.greatest(F.sum("bytes").over(Window.partitionBy()), F.lit(1))
    return by.withColumn("percent", F.round(100 * F.col("bytes") / total, 2))


def noisy_or(signals: DataFrame, key: str, weight: str, least: float = 0.5) -> DataFrame:
    """1 - product of (1 - weight) by key, rounded to three places; keys at or above ``least``."""
    by = signals.groupBy(key).agg(F.array_sort(F.collect_list(weight)).alias("w"))
    missing = F.aggregate("w", F.lit(1.0), lambda a, w: a * (1 - w))
    return by.select(key, F.round(1 - missing, 3).alias("confidence"), F.size("w").cast("bigint").alias("signals")).where(F.col("confidence") >= least)


def unique_by_name(symbols_: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(name, language, id) of symbols of the kinds whose name is theirs alone in their language."""
    return symbols_.where(F.col("kind").isin(*kinds)).groupBy("name", "language").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def first_match(callees: DataFrame, catalog: DataFrame, qname: str = "dst_qname", preview: str | None = None) -> DataFrame:
    """The first catalog pattern, by ord, that fits each distinct callee: qname (and preview), pattern_id, category, severity.

    ``catalog`` has pattern_id, ord, prefix (null: any), regex, hint (null:
    none), category, severity. Its size is the number of patterns, a few
    hundred; only distinct callees meet it. A hint that fails lets the next
    pattern try.
    """
    keys = [qname] + ([preview] if preview else [])
    distinct = callees.select(*keys).where(F.col(qname).isNotNull()).distinct()
    c = F.broadcast(catalog)
    fits = (c["prefix"].isNull() | (prefix_of(distinct[qname]) == c["prefix"])) & F.expr(f"{qname} RLIKE regex")
    if preview:
        fits = fits & (c["hint"].isNull() | F.expr(f"coalesce({preview}, '') RLIKE hint"))
    hits = distinct.join(c, fits)
    best = hits.groupBy(*keys).agg(F.min_by(F.struct("pattern_id", "category", "severity"), "ord").alias("m"))
    return best.select(*keys, "m.pattern_id", "m.category", F.coalesce("m.severity", F.lit("medium")).alias("severity"))


def catalog_rows(patterns: Sequence[tuple[str, str, str, str | None, str | None]]) -> list[tuple]:
    """Rows for :func:`first_match` from (id, pattern, category, severity, hint) in order."""
    out = []
    for i, (pid, pattern, category, severity, hint) in enumerate(patterns):
        prefix, colon, _ = pattern.partition(":")
        out.append((pid, i, prefix if colon else None, catalog_regex(pattern), hint, category, severity))
    return out


CATALOG_SCHEMA = "pattern_id string, ord int, prefix string, regex string, hint string, category string, severity string"


def coverage(catalog: DataFrame) -> DataFrame:
    """Sinks and sources by prefix, with a tier: full, partial or minimal."""
    sink = F.col("severity").isNotNull()
    by = catalog.groupBy("prefix").agg(F.count_if(sink).alias("sinks"), F.count_if(~sink).alias("sources"))
    return by.withColumn("tier", F.when((F.col("sinks") < 9) | (F.col("sources") < 1), "minimal").when((F.col("sinks") >= 12) & (F.col("sources") >= 2), "full").otherwise("partial"))


def _pieces(spans: DataFrame) -> DataFrame:
    """Spans (__low, __high) with a row for each aligned block of 2 ** __level lines, the __cell-th, that they are made of.

    The blocks of a span do not overlap, so a line in it is in just one of them;
    there are at most twice as many as the span's length has binary digits.
    """
    low, high = F.col("__low"), F.col("__high")

    def at(k: Column) -> Column:
        first, after = -F.call_function("shiftright", -low, k), F.call_function("shiftright", high + 1, k)
        odd = lambda c: (first < after) & (c.bitwiseAND(1) == 1)
        piece = lambda c: F.struct(k.alias("__level"), c.alias("__cell"))
        return F.array(F.when(odd(first), piece(first)), F.when(odd(after), piece(after - 1)))

    levels = F.sequence(F.lit(0), F.length(F.bin(high - low + 1)) - 1)
    whole = spans.where(low <= high)
    return whole.withColumn("__p", F.explode(F.array_compact(F.flatten(F.transform(levels, at))))).select(*spans.columns, "__p.*")


def _cells(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (file_id, line) with a row for each block, of any size that a piece of ``spans`` can have, that they are in."""
    most = spans.agg(F.max(F.col("__high") - F.col("__low") + 1).alias("__most"))
    level = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.greatest("__most", F.lit(1)))) - 1))
    out = lines.where(F.col("file_id").isNotNull() & F.col("line").isNotNull()).crossJoin(F.broadcast(most.where("__most IS NOT NULL")))
    out = out.withColumn("__level", level).drop("__most")
    return out.withColumn("__cell", F.call_function("shiftright", F.col("line").cast("bigint"), F.col("__level")))


def _best_over(points: DataFrame, spans: DataFrame, best: Callable[[str], Column]) -> DataFrame:
    """Points with the best __v of all spans (__f, __low, __high, __v) over them; those under none are left out.

    Different lines meet the best of each block of lines, so no point meets a
    span by itself, however many there are in a file.
    """
    tops = _pieces(spans.groupBy("__f", "__low", "__high").agg(best("__v").alias("__v"))).groupBy("__f", "__level", "__cell").agg(best("__v").alias("__v"))
    tops = tops.withColumnRenamed("__level", "__l").withColumnRenamed("__cell", "__c")
    lines = _cells(points.select("file_id", "line").distinct(), spans)
    over = lines.join(tops, (F.col("file_id") == F.col("__f")) & (F.col("__level") == F.col("__l")) & (F.col("__cell") == F.col("__c")))
    return points.join(over.groupBy("file_id", "line").agg(best("__v").alias("__v")), ["file_id", "line"])


def contained(points: DataFrame, spans: DataFrame, inclusive: bool = True) -> DataFrame:
    """Points (file_id, line) inside spans (file_id, start_line, end_line): equality on the file, a range on the line.

    Every pair is a row, but only those: different lines meet different spans by
    blocks of lines. Points of one line and spans of the same lines then meet as
    lists of about ``LISTED``, dealt over all tasks, and are paired there.
    """
    s = spans.select(F.col("file_id").alias("__f"), F.col("id").alias("span_id"), F.col("start_line").alias("__s"), F.col("end_line").alias("__e"))
    s = s.withColumn("__low", F.col("__s").cast("bigint") + (0 if inclusive else 1)).withColumn("__high", F.col("__e").cast("bigint"))
    some = F.count(F.lit(1))
    pieces = _pieces(s.groupBy("__f", "__s", "__e", "__low", "__high").agg(some.alias("__ns"))).withColumnRenamed("__level", "__l").withColumnRenamed("__cell", "__c")
    lines = _cells(points.groupBy("file_id", "line").agg(some.alias("__np")), s)
    met = lines.join(pieces, (F.col("file_id") == F.col("__f")) & (F.col("__level") == F.col("__l")) & (F.col("__cell") == F.col("__c"))).select("__f", "line", "__np", "__s", "__e", "__ns")
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.ceil(F.col(n) / LISTED))
    own = met.select(F.col("__f").alias("file_id"), "line", "__np").distinct()
    ps = points.join(own, ["file_id", "line"]).groupBy(F.col("file_id").alias("__f"), "line", deal("__np", *points.columns).alias("__pk")).agg(F.collect_list(F.struct(*points.columns)).alias("__ps"))
    own = met.select("__f", "__s", "__e", "__ns").distinct()
    ss = s.join(own, ["__f", "__s", "__e"]).groupBy("__f", "__s", "__e", deal("__ns", "span_id").alias("__sk")).agg(F.collect_list(F.struct("span_id")).alias("__ss"))
    both = met.select("__f", "line", "__s", "__e").join(ps, ["__f", "line"]).join(ss, ["__f", "__s", "__e"])
    both = both.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__f", "line", "__pk", "__s", "__e", "__sk")
    out = both.select(F.explode("__ps").alias("__p"), "__ss", "__s", "__e").select("__p", F.explode("__ss").alias("__x"), "__s", "__e")
    return out.select("__p.*", "__x.span_id", F.col("__s").alias("start_line"), F.col("__e").alias("end_line"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: str = "id") -> DataFrame:
    """For each point the span that encloses it most tightly."""
    long = lambda c: F.col(c).cast("bigint")
    s = spans.select(F.col("file_id").alias("__f"), long("start_line").alias("__low"), long("end_line").alias("__high"), F.struct((long("end_line") - long("start_line")).alias("n"), F.col("id").alias("span_id")).alias("__v"))
    return _best_over(points, s, F.min).groupBy(key).agg(F.min("__v")["span_id"].alias("span_id"))


def nearest_preceding(points: DataFrame, blocks: DataFrame, key: str, gap: int) -> DataFrame:
    """For each point the last block of its file that ends at most ``gap`` lines before it."""
    end = F.col("end_line").cast("bigint")
    b = blocks.select(F.col("file_id").alias("__f"), end.alias("__low"), (end + gap).alias("__high"), F.struct(end.alias("end_line"), F.col("id").alias("block_id")).alias("__v"))
    return _best_over(points, b, F.max).groupBy(key).agg(F.max("__v")["block_id"].alias("block_id"))


def best_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def first_of_each(df: DataFrame, key: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= cap).drop("__rn")


def evidence(signals: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The signals that fired for each key, once each, in their order."""
    fired = signals.groupBy(key, text).agg(F.min(order).alias("__o")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", text))).alias("e"))
    return fired.select(key, F.transform("e", lambda x: x[text]).alias("evidence"))


def last_lines(modules: DataFrame, *spans: DataFrame) -> DataFrame:
    """Last line of each module (id), from all its spans (file_id, end_line) of symbols, references and imports; 1 without any."""
    ends = None
    for x in spans:
        own = x.where(F.col("file_id").isNotNull()).groupBy(F.col("file_id").alias("id")).agg(F.max("end_line").cast("int").alias("end_line"))
        ends = own if ends is None else ends.unionByName(own)
    ends = ends.groupBy("id").agg(F.max("end_line").alias("end_line"))
    return modules.select("id").join(ends, "id", "left").select("id", F.coalesce("end_line", F.lit(1)).alias("end_line"))


def stale(current: int) -> Column:
    """Whether the column analyzer_version of repositories (null: none) is behind ``current``."""
    return F.coalesce(F.col("analyzer_version"), F.lit(0)) < current


def source_kind(explicit: str = "explicit", spec: str = "spec", extra: str = "extra") -> Column:
    """How a path's head became a source: explicit, spec, handler_params (the entrypoint names tainted ones) or handler."""
    tainted = F.from_json(F.col(extra), "tainted_params array<string>")["tainted_params"]
    return F.when(F.col(explicit), "explicit").when(F.col(spec), "spec").when(F.coalesce(F.size(tainted), F.lit(0)) > 0, "handler_params").otherwise("handler")


def first_source(edges: DataFrame, head: str = "src") -> DataFrame:
    """For each head its source edge of the lowest line (then id) that has a channel or a key."""
    told = edges.where(F.col("channel").isNotNull() | F.col("source_key").isNotNull())
    return told.groupBy(head).agg(F.min_by(F.struct("channel", "source_key", "line"), F.struct("line", "id")).alias("m")).select(head, "m.*")


def accessor_lines(edges: DataFrame, head: str = "src") -> DataFrame:
    """The different lines on which each head reads a source."""
    return edges.where(F.col("source_id").isNotNull()).groupBy(head).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def flows_by_parameter(flows: DataFrame, params: DataFrame) -> DataFrame:
    """Flows (entrypoint_id, source_key, path) under the parameter they read; those of no parameter under null.

    Every parameter has a row; its flows are in order of their path.
    """
    p = params.select("entrypoint_id", F.col("name").alias("source_key")).distinct().withColumn("parameter", F.col("source_key"))
    both = flows.join(p, ["entrypoint_id", "source_key"], "full_outer")
    return both.groupBy("entrypoint_id", "parameter").agg(F.array_sort(F.collect_list("path")).alias("paths"))
