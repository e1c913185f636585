"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .operators import catalog as C
from .operators import entrypoints as EP
from .operators import frameworks as FW
from .operators import graph as G
from .operators import maintenance as M
from .operators import relational as R
from .operators import resolve as RS
from .operators import search as S
from .plans.projections import duckdb_sql, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a function of a loader ``t`` (name to DataFrame), with SQL over the projections."""

    def register(f):
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = lambda spark, d, f=f: f(lambda n: view(spark, d, n))
        if sql:
            _ORACLES[name] = duckdb_sql(sql)
        return f

    return register


# Listings and filters


@_query("SELECT id, kind, name, qname FROM {symbols} WHERE kind <> 'external' AND qname ILIKE 'nation$_1%.customer#0000000%' ESCAPE '$' ORDER BY qname, id")
def q_f1_symbols_glob(t):
    return R.symbols(t("symbols"), qname="nation_1*.customer#0000000*").select("id", "kind", "name", "qname")


@_query("SELECT id, qname FROM {symbols} WHERE kind = 'external' AND name LIKE '%a%'")
def q_f1_symbols_kind(t):
    return R.symbols(t("symbols"), kind="external", name="*a*").where(F.col("name").contains("a")).select("id", "qname")


@_query("SELECT id, qname FROM {symbols} WHERE qname = 'ASIA.NATION_2'")
def q_f2_symbol_exact(t):
    return R.symbols(t("symbols"), qname="ASIA.NATION_2", include_external=True).select("id", "qname")


@_query("SELECT id, qname FROM {symbols} WHERE kind <> 'external' AND (qname > 'orders.o5' OR (qname = 'orders.o5' AND id > 10000005)) ORDER BY qname, id LIMIT 50")
def q_f3_keyset_page(t):
    return R.symbols(t("symbols"), after=("orders.o5", 10000005), limit=50).select("id", "qname")


@_query("SELECT path, language, size_bytes FROM {files} WHERE language = 'de' AND path ILIKE 'SRC1%/%'")
def q_f4_files(t):
    return R.files(t("files"), language="de", path="SRC1*/*").select("path", "language", "size_bytes")


@_query("""SELECT e.id, e.kind, e.framework, e.route, s.qname AS handler, coalesce(p.params, '') AS params
FROM {entrypoints} e JOIN {symbols} s ON s.id = e.symbol_id
LEFT JOIN (SELECT entrypoint_id, string_agg(name, ',' ORDER BY id) AS params FROM {params} GROUP BY 1) p ON p.entrypoint_id = e.id
WHERE e.route LIKE '/en/%'""")
def q_f6_entrypoints(t):
    out = R.entrypoints(t("entrypoints"), t("symbols"), t("params"), route="/en/*")
    return out.select("id", "kind", "framework", "route", "handler", F.array_join("params", ",").alias("params"))


@_query("SELECT id, confidence, via FROM {hops} WHERE confidence >= 2 AND via IS DISTINCT FROM 'cha'")
def q_f10_edge_filter(t):
    return t("hops").where(R.usable(floor=2)).select("id", "confidence", "via")


@_query(r"""SELECT id, regexp_matches(trim(coalesce(arg_preview, '')), '^(?:[\s,=()\[\]{{}}:]|''[^'']*''|"[^"]*"|[0-9][0-9_.eExXaAbBcCdDfF]*|True|False|None|null|true|false|nil|[A-Za-z_][A-Za-z0-9_]*\s*=)*$') AS constant,
CASE WHEN regexp_matches(arg_preview, '"[^"]*"') THEN regexp_extract(arg_preview, '"([^"]*)"', 1) END AS source_key FROM {edges}""")
def q_f12_constant_args(t):
    return t("edges").select("id", P.constant_args(F.col("arg_preview")).alias("constant"), P.first_string_arg(F.col("arg_preview")).alias("source_key"))


# Joins


@_query("SELECT s.id, s.qname, f.path, p.qname AS parent_qname FROM {symbols} s LEFT JOIN {files} f ON f.id = s.file_id LEFT JOIN {symbols} p ON p.id = s.parent_id")
def q_j1_j4_symbols_files_parents(t):
    return R.with_parent(R.with_file(t("symbols"), t("files"))).select("id", "qname", "path", "parent_qname")


@_query("SELECT e.src, s.qname, e.dst FROM {symbols} s JOIN {edges} e ON e.src = s.id AND e.kind IN ('inherits', 'implements')")
def q_j5_bases(t):
    e = t("edges").where(F.col("kind").isin("inherits", "implements"))
    return e.join(t("symbols").select(F.col("id").alias("src"), "qname"), "src").select("src", "qname", "dst")


@_query("""SELECT e.id, e.kind, e.dst, coalesce(s.qname, '?') AS src_qname FROM {edges} e LEFT JOIN {symbols} s ON s.id = e.src
WHERE e.dst IN (SELECT id FROM {symbols} WHERE kind = 'class')""")
def q_j7_references(t):
    return R.references(t("edges"), t("symbols"), t("symbols").where("kind = 'class'")).select("id", "kind", "dst", "src_qname")


_PATTERNS = (
    ("py.misty", "py:*.{small, blue} *", "sql", "high", None),
    ("py.brand", "py:Brand#1?.*", "command_exec", None, None),
    ("py.any", "py:*a*e*", "file_write", "low", None),
    ("any.z", "*[xyz]*", "code_eval", "critical", None),
)
_CATALOG_SQL = """(SELECT * FROM (VALUES ('py.misty', 0, '^py:.*\\.(small|blue) .*$', 'sql', 'high'), ('py.brand', 1, '^py:Brand#1.\\..*$', 'command_exec', 'medium'),
('py.any', 2, '^py:.*a.*e.*$', 'file_write', 'low'), ('any.z', 3, '^.*[xyz].*$', 'code_eval', 'critical')) c(pattern_id, ord, rx, category, severity))"""


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.catalog_rows(_PATTERNS), R.CATALOG_SCHEMA)


@_query(f"""SELECT qname, pattern_id, category, severity FROM (SELECT s.qname, c.*, row_number() OVER (PARTITION BY s.qname ORDER BY ord) AS rn
FROM (SELECT DISTINCT qname FROM {{symbols}} WHERE kind = 'external') s JOIN {_CATALOG_SQL} c ON regexp_matches(s.qname, c.rx)) WHERE rn = 1""".replace("{{symbols}}", "{symbols}"))
def q_j10_catalog_match(t):
    s = t("symbols").where("kind = 'external'")
    return R.first_match(s, _catalog(s.sparkSession), "qname")


@_query("""SELECT p.name, p.location, count(e.id) AS flows FROM {params} p LEFT JOIN {entrypoints} e ON e.id = p.entrypoint_id AND e.kind = 'http_route' GROUP BY 1, 2""")
def q_j13_param_flows(t):
    e = t("entrypoints").where("kind = 'http_route'").select(F.col("id").alias("entrypoint_id"), F.lit(1).alias("flow"))
    return t("params").join(e, "entrypoint_id", "left").groupBy("name", "location").agg(F.count("flow").alias("flows"))


@_query("""SELECT e.id, s.id AS span_id FROM (SELECT id, src % 50 + 1 AS file_id, line FROM {hops}) e
JOIN {symbols} s ON s.file_id = e.file_id AND s.kind = 'function' AND s.start_line <= e.line AND e.line <= s.end_line""")
def q_j16_span_containment(t):
    points = t("hops").select("id", (F.col("src") % 50 + 1).alias("file_id"), "line")
    return R.contained(points, t("symbols").where("kind = 'function'")).select("id", "span_id")


@_query("""SELECT e.id, arg_max(s.id, struct_pack(a := s.end_line, b := s.id)) AS block_id FROM (SELECT id, src % 50 + 1 AS file_id, line FROM {hops}) e
JOIN {symbols} s ON s.file_id = e.file_id AND s.kind = 'function' AND s.end_line <= e.line AND e.line - s.end_line <= 2 GROUP BY 1""")
def q_j17_nearest_block(t):
    points = t("hops").select("id", (F.col("src") % 50 + 1).alias("file_id"), "line")
    return R.nearest_preceding(points, t("symbols").where("kind = 'function'"), "id", 2)


@_query("""SELECT e.id, arg_min(s.id, struct_pack(a := s.end_line - s.start_line, b := s.id)) AS span_id FROM (SELECT id, src % 50 + 1 AS file_id, line FROM {hops}) e
JOIN {symbols} s ON s.file_id = e.file_id AND s.kind IN ('function', 'method', 'class') AND s.start_line <= e.line AND e.line <= s.end_line GROUP BY 1""")
def q_j18_smallest_enclosing(t):
    points = t("hops").select("id", (F.col("src") % 50 + 1).alias("file_id"), "line")
    return R.smallest_enclosing(points, t("symbols").where(F.col("kind").isin("function", "method", "class")))


# Aggregates


@_query("""SELECT (SELECT count(*) FROM {files}) AS files, (SELECT count(*) FROM {symbols}) AS symbols, count(*) AS edges, count(dst) AS resolved,
count(sink_id) AS sinks, count(source_id) AS sources, (SELECT count(*) FROM {entrypoints}) AS entrypoints FROM {edges}""")
def q_g1_stats(t):
    return R.stats(t("files"), t("symbols"), t("edges"), t("entrypoints"))


@_query("""SELECT language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(100 * sum(size_bytes) / greatest(sum(sum(size_bytes)) OVER (), 1), 2) AS percent FROM {files} GROUP BY 1""")
def q_g2_language_profile(t):
    return R.language_profile(t("files"))


@_query("""SELECT framework, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list_sort(list(w))), lambda a, x: a * (1 - x)), 3) AS confidence, count(*) AS signals
FROM (SELECT DISTINCT 'f' || CAST(id % 40 AS STRING) AS framework, id % 7 AS k, (id % 7) / 10.0::DOUBLE AS w FROM {entrypoints}) GROUP BY 1 HAVING confidence >= 0.5""")
def q_g3_noisy_or(t):
    e = t("entrypoints").select(F.concat(F.lit("f"), F.col("id") % 40).alias("framework"), (F.col("id") % 7).alias("k"), ((F.col("id") % 7) / F.lit(10.0)).alias("w")).distinct()
    return R.noisy_or(e, "framework", "w")


@_query("SELECT name, language, min(id) AS id FROM {defs} WHERE kind IN ('method', 'function') GROUP BY name, language HAVING count(*) = 1")
def q_g9_unique_by_name(t):
    return R.unique_by_name(t("defs"), ["method", "function"])


@_query("""SELECT f.repo_id, count(*) AS files, count(DISTINCT language) AS languages, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(skip_reason) AS skipped FROM {files} f GROUP BY 1""")
def q_g11_repo_rollup(t):
    return t("files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("languages"), F.sum("size_bytes").alias("bytes"), F.count("skip_reason").alias("skipped"))


@_query("""SELECT src, min(id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY confidence DESC, line, id) AS rn FROM {hops}) WHERE rn = 1 GROUP BY src""")
def q_r4_best_first(t):
    best = R.best_first(t("hops"), ["src", "kind"], [F.desc("confidence"), F.col("line"), F.col("id")])
    return best.groupBy("src").agg(F.min("id").alias("id"))


@_query("SELECT src, id FROM (SELECT src, id, row_number() OVER (PARTITION BY src ORDER BY id) AS rn FROM {hops}) WHERE rn <= 8")
def q_r8_cap(t):
    return R.first_of_each(t("hops").select("src", "id"), ["src"], [F.col("id")], 8)


@_query("""SELECT name, array_to_string(list_sort(list(signal)), ',') AS evidence FROM (SELECT DISTINCT 'f' || CAST(id % 40 AS STRING) AS name, 's' || CAST(id % 7 AS STRING) AS signal FROM {entrypoints}) GROUP BY 1""")
def q_g4_evidence(t):
    e = t("entrypoints").select(F.concat(F.lit("f"), F.col("id") % 40).alias("name"), F.concat(F.lit("s"), F.col("id") % 7).alias("signal"), (F.col("id") % 7).alias("ord"))
    return R.evidence(e, "name", "signal", "ord").select("name", F.array_join("evidence", ",").alias("evidence"))


@_query(f"""SELECT p AS prefix, CAST(count_if(s) AS BIGINT) AS sinks, CAST(count_if(NOT s) AS BIGINT) AS sources,
CASE WHEN count_if(s) < 9 OR count_if(NOT s) < 1 THEN 'minimal' WHEN count_if(s) >= 12 AND count_if(NOT s) >= 2 THEN 'full' ELSE 'partial' END AS tier
FROM (SELECT p_brand AS p, p_size > 20 AS s FROM {{part}}) GROUP BY 1""".replace("{{", "{").replace("}}", "}"))
def q_g5_coverage(t):
    return R.coverage(t("part").select(F.col("p_brand").alias("prefix"), F.when(F.col("p_size") > 20, "high").alias("severity")))


@_query("""SELECT f.id, coalesce(m.e, 1) AS end_line FROM {files} f LEFT JOIN (SELECT file_id, max(e) AS e FROM (SELECT file_id, end_line AS e FROM {symbols}
UNION ALL SELECT src % 60, line FROM {hops} UNION ALL SELECT file_id, ordinal + 1 FROM {brings}) GROUP BY 1) m ON m.file_id = f.id""")
def q_g8_last_lines(t):
    refs = t("hops").select((F.col("src") % 60).alias("file_id"), F.col("line").alias("end_line"))
    return R.last_lines(t("files"), t("symbols"), refs, t("brings").select("file_id", (F.col("ordinal") + 1).alias("end_line")))


@_query("SELECT kind, count(*) AS n FROM {symbols} GROUP BY 1")
def q_g10_count_symbols(t):
    return t("symbols").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_FLOWS = "SELECT id AS entrypoint_id, CASE id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'ref' ELSE 'other' END AS source_key, CAST(symbol_id AS STRING) AS path FROM {entrypoints}"


@_query(f"""SELECT entrypoint_id, parameter, string_agg(path, ',' ORDER BY path) AS paths FROM (
SELECT coalesce(f.entrypoint_id, p.entrypoint_id) AS entrypoint_id, p.name AS parameter, f.path FROM ({_FLOWS}) f
FULL OUTER JOIN (SELECT DISTINCT entrypoint_id, name FROM {{params}}) p ON p.entrypoint_id = f.entrypoint_id AND p.name = f.source_key) GROUP BY 1, 2""".replace("{{", "{").replace("}}", "}"))
def q_p17_flows_by_parameter(t):
    key = F.when(F.col("id") % 3 == 0, "page").when(F.col("id") % 3 == 1, "ref").otherwise("other")
    flows = t("entrypoints").select(F.col("id").alias("entrypoint_id"), key.alias("source_key"), F.col("symbol_id").cast("string").alias("path"))
    out = R.flows_by_parameter(flows, t("params"))
    return out.select("entrypoint_id", "parameter", F.when(F.size("paths") > 0, F.array_join("paths", ",")).alias("paths"))


@_query("""SELECT src, channel, source_key, line FROM (SELECT src, via AS channel, CASE WHEN id % 3 = 0 THEN kind END AS source_key, line, row_number() OVER (PARTITION BY src ORDER BY line, id) AS rn
FROM {hops} WHERE via IS NOT NULL OR id % 3 = 0) WHERE rn = 1""")
def q_g14_first_source(t):
    e = t("hops").select("id", "src", "line", F.col("via").alias("channel"), F.when(F.col("id") % 3 == 0, F.col("kind")).alias("source_key"))
    return R.first_source(e)


@_query("SELECT src, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM {hops} WHERE via IS NOT NULL GROUP BY 1")
def q_g15_accessor_lines(t):
    return R.accessor_lines(t("hops").withColumn("source_id", F.col("via"))).select("src", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@_query("""SELECT id, CASE WHEN id % 10 = 0 THEN 'explicit' WHEN id % 10 = 1 THEN 'spec' WHEN extra LIKE '%tainted_params%' THEN 'handler_params' ELSE 'handler' END AS source_kind FROM {entrypoints}""")
def q_p14_source_kind(t):
    e = t("entrypoints").withColumns({"explicit": F.col("id") % 10 == 0, "spec": F.col("id") % 10 == 1})
    return e.select("id", R.source_kind().alias("source_kind"))


@_query("SELECT repo_id, coalesce(v, 0) < 5 AS stale FROM (SELECT DISTINCT repo_id, CASE WHEN repo_id % 3 > 0 THEN repo_id % 9 END AS v FROM {files})")
def q_f15_stale(t):
    r = t("files").select("repo_id").distinct().withColumn("analyzer_version", F.when(F.col("repo_id") % 3 > 0, F.col("repo_id") % 9))
    return r.select("repo_id", R.stale(5).alias("stale"))


@_query("""SELECT id, kind, route, framework FROM {entrypoints} WHERE framework IN ('flask', 'gin') OR id IN (SELECT entrypoint_id FROM {params} WHERE name = 'ref')""")
def q_f8_spec_union(t):
    by_name = t("entrypoints").where(F.col("framework").isin("flask", "gin")).select("id")
    ids = by_name.union(t("params").where("name = 'ref'").select("entrypoint_id")).distinct()
    return t("entrypoints").join(ids, "id", "left_semi").select("id", "kind", "route", "framework")


# Maintenance


@_query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT path, content_hash FROM {files} WHERE id % 5 <> 0) a FULL OUTER JOIN (SELECT path, CASE WHEN id % 4 = 0 THEN 'x' ELSE content_hash END AS content_hash FROM {files} WHERE id % 7 <> 0) b ON a.path = b.path""")
def q_a8_file_diff(t):
    known = t("files").where("id % 5 <> 0")
    found = t("files").where("id % 7 <> 0").withColumn("content_hash", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("content_hash")))
    return M.file_diff(known, found)


_DEAD = "(SELECT id FROM {symbols} WHERE file_id % 9 = 0)"


@_query(f"SELECT id, src, CASE WHEN dst NOT IN {_DEAD} THEN dst END AS dst FROM {{edges}} WHERE src NOT IN {_DEAD}".replace("{{", "{").replace("}}", "}"))
def q_w3_wipe_files(t):
    dead = t("symbols").where("file_id % 9 = 0").select(F.col("file_id").alias("id")).distinct()
    return M.wipe_files(t("symbols"), t("edges"), dead)[1].select("id", "src", "dst")


_PARTS = "SELECT 'py:p' || CAST(p_partkey AS STRING) AS qname, p_partkey + 5000000 AS id FROM {part} WHERE p_size > 25"


@_query(f"""SELECT e.id, coalesce(e.dst, s.id) AS dst, CASE WHEN e.dst IS NULL AND s.id IS NOT NULL AND e.confidence = 0 THEN 2 ELSE e.confidence END AS confidence
FROM {{edges}} e LEFT JOIN ({_PARTS}) s ON e.dst IS NULL AND s.qname = e.dst_qname""".replace("{{", "{").replace("}}", "}"))
def q_w5_heal(t):
    parts = t("part").where("p_size > 25").select(F.concat(F.lit("py:p"), F.col("p_partkey")).alias("qname"), (F.col("p_partkey") + 5000000).alias("id"))
    return M.heal(t("edges"), parts).select("id", "dst", "confidence")


@_query("SELECT id, kind FROM {symbols} s WHERE kind <> 'external' OR id IN (SELECT l_partkey + 5000000 FROM {lineitem} WHERE l_quantity > 49)")
def q_w6_collect_orphans(t):
    into = t("lineitem").where("l_quantity > 49").select((F.col("l_partkey") + 5000000).alias("dst"))
    return M.collect_orphans(t("symbols"), into).select("id", "kind")


@_query("""SELECT name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, n DESC) AS rn FROM (
SELECT p_brand AS name, round(max(p_size) / 60.0::DOUBLE, 2) AS confidence, 0 AS n FROM {part} GROUP BY 1 UNION ALL SELECT p_brand, round(min(p_retailprice) / 2000, 2), 1 FROM {part} GROUP BY 1)) WHERE rn = 1""")
def q_w7_merge_detections(t):
    p = t("part").groupBy(F.col("p_brand").alias("name"))
    old = p.agg(F.round(F.max("p_size") / F.lit(60.0), 2).alias("confidence"))
    return M.merge_detections(old, p.agg(F.round(F.min("p_retailprice") / 2000, 2).alias("confidence")))


@_query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY kind, src, dst_qname, line, sink_id, via ORDER BY id) AS rn FROM
(SELECT id, kind, src % 100 AS src, substr(dst_qname, 1, 4) AS dst_qname, line, sink_id, via FROM {edges})) WHERE rn = 1""")
def q_w8_edge_dedup(t):
    e = t("edges").withColumn("src", F.col("src") % 100).withColumn("dst_qname", F.substring("dst_qname", 1, 4))
    return M.dedup_edges(e).select("id")


@_query("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) + 500 AS id FROM {customer}")
def q_w2_allocate_ids(t):
    return M.with_ids(t("customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 500).select("c_custkey", "id")


@_query("""SELECT id, name, type_ref FROM (SELECT *, row_number() OVER (PARTITION BY entrypoint_id, name, location ORDER BY id) AS rn FROM (
SELECT o_orderkey AS id, o_custkey AS entrypoint_id, substr(o_orderpriority, 1, 4) AS name, o_orderstatus AS location, substr(o_orderpriority, 3, 64) AS type_ref FROM {orders})) WHERE rn = 1""")
def q_w9_parameter_dedup(t):
    p = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entrypoint_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("location"), F.expr("substr(o_orderpriority, 3)").alias("type_ref"))
    return M.dedup_parameters(p, name_most=4).select("id", "name", "type_ref")


@_query("SELECT s.id, coalesce(t.type_ref, CASE WHEN s.id % 2 = 0 THEN 'old' END) AS type_ref FROM {symbols} s LEFT JOIN (SELECT c_custkey + 1000000 AS id, c_mktsegment AS type_ref FROM {customer} WHERE c_custkey % 3 = 0) t ON t.id = s.id")
def q_w10_type_update(t):
    types = t("customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_mktsegment").alias("type_ref"))
    return M.update_column(t("symbols").withColumn("type_ref", F.when(F.col("id") % 2 == 0, "old")), types, "id", "type_ref").select("id", "type_ref")


# Traversal

_CALLS = "SELECT DISTINCT src, dst FROM {hops} WHERE kind = 'calls' AND confidence >= 1 AND via IS DISTINCT FROM 'cha'"


def _hops(t):
    return G.adjacency(t("hops"))


def _ids(t, *ids):
    return t("hops").sparkSession.createDataFrame([(i,) for i in ids], "id bigint")


@_query(f"""WITH RECURSIVE w(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT c.dst, w.depth + 1 FROM w JOIN ({_CALLS}) c ON c.src = w.id WHERE w.depth < 2)
SELECT id, min(depth) AS depth FROM w WHERE id <> 7 GROUP BY id""")
def q_p1_neighborhood(t):
    return G.neighborhood(_ids(t, 7), _hops(t), 2)


@_query(f"SELECT DISTINCT src AS id, 1 AS depth FROM ({_CALLS}) WHERE dst = 9 AND src <> 9")
def q_p2_callers(t):
    return G.callers(_ids(t, 9), _hops(t))


@_query(f"SELECT DISTINCT dst AS id, 1 AS depth FROM ({_CALLS}) WHERE src = 9 AND dst <> 9")
def q_p3_callees(t):
    return G.callees(_ids(t, 9), _hops(t))


@_query(f"""WITH RECURSIVE w(id, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT c.src, w.depth + 1 FROM w JOIN ({_CALLS}) c ON c.dst = w.id WHERE w.depth < 3)
SELECT DISTINCT id FROM w""")
def q_p5_reachable(t):
    return G.reachable(_hops(t).select(F.col("src").alias("id")).union(_hops(t).select("dst")), _ids(t, 5), _hops(t), 3)


_FLOW = "SELECT id, src, dst, sink_id, confidence FROM {edges} WHERE dst IS NOT NULL AND kind IN ('calls', 'inherits') AND confidence >= 1 AND via IS DISTINCT FROM 'cha'"
_SOURCES = "SELECT c_custkey + 1000000 AS id FROM {customer} WHERE c_mktsegment = 'BUILDING'"
_PATHS = f"""WITH RECURSIVE e AS ({_FLOW}), w(nodes, edge_ids, node, sink_id, low) AS (
SELECT [e.src, e.dst], [e.id], e.dst, e.sink_id, e.confidence FROM e JOIN ({_SOURCES}) s ON s.id = e.src WHERE e.src <> e.dst
UNION ALL SELECT list_append(w.nodes, e.dst), list_append(w.edge_ids, e.id), e.dst, e.sink_id, least(w.low, e.confidence)
FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.nodes, e.dst) AND len(w.edge_ids) < 4 AND NOT (w.node BETWEEN 100 AND 124)),
p AS (SELECT * FROM w WHERE node BETWEEN 100 AND 124 AND sink_id IS NOT NULL)"""


def _flow(t):
    return G.adjacency(t("edges"), ("calls", "inherits"))


def _flow_paths(t, open_nodes=None):
    sources = t("customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1000000).alias("id"))
    sinks = t("symbols").where("kind = 'class'").select("id")
    return G.simple_paths(sources, sinks, _flow(t), 4, F.col("sink_id").isNotNull(), open_nodes)


@_query(_PATHS + " SELECT array_to_string(nodes, '>') AS nodes, array_to_string(edge_ids, '>') AS edge_ids FROM p")
def q_p6_paths(t):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ">").alias(c)
    return _flow_paths(t).select(join("nodes"), join("edge_ids"))


_RANKED = """, r AS (SELECT nodes, edge_ids, len(nodes) AS n_nodes, low AS min_confidence, sink_id,
CASE sink_id WHEN 'py.command-exec.os' THEN 'high' ELSE 'medium' END AS severity FROM p)
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(edge_ids, '>') AS edge_ids, CAST(n_nodes AS INT) AS n_nodes, min_confidence, sink_id, severity FROM r
ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, min_confidence DESC, n_nodes, r.nodes, r.edge_ids LIMIT 10"""


@_query(_PATHS + _RANKED)
def q_r1_ranked_paths(t):
    rows = _flow_paths(t).withColumn("n_nodes", F.size("nodes")).withColumn("severity", F.when(F.col("sink_id") == "py.command-exec.os", "high").otherwise("medium"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ">").alias(c)
    return G.ranked(rows, 10).select(join("nodes"), join("edge_ids"), "n_nodes", "min_confidence", "sink_id", "severity")


@_query(_PATHS + """, o AS (SELECT DISTINCT src FROM {edges} WHERE dst IS NOT NULL AND kind IN ('calls', 'inherits') AND (confidence < 1 OR via IN ('cha', 'dynamic')))
SELECT array_to_string(edge_ids, '>') AS edge_ids, len(list_filter(nodes, lambda n: n IN (SELECT src FROM o))) > 0 AS may_continue FROM p""".replace("len(list_filter(nodes, lambda n: n IN (SELECT src FROM o))) > 0", "EXISTS (SELECT 1 FROM o WHERE list_contains(p.nodes, o.src))"))
def q_p15_may_continue(t):
    out = _flow_paths(t, G.open_nodes(t("edges"), ("calls", "inherits")))
    return out.select(F.array_join(F.col("edge_ids").cast("array<string>"), ">").alias("edge_ids"), "may_continue")


_PARENTS = "SELECT id, parent_id AS parent FROM {symbols} WHERE parent_id IS NOT NULL"


@_query(f"""WITH RECURSIVE w(id, ancestor, depth) AS (SELECT id, parent, 1 FROM ({_PARENTS}) UNION ALL
SELECT w.id, p.parent, w.depth + 1 FROM w JOIN ({_PARENTS}) p ON p.id = w.ancestor WHERE w.depth < 10)
SELECT id, ancestor, min(depth) AS depth FROM w GROUP BY 1, 2""")
def q_p19_ancestors(t):
    return G.ancestors(t("symbols").select("id", F.col("parent_id").alias("parent")))


@_query("""WITH m AS (SELECT c_custkey AS id, c_mktsegment || CAST(c_custkey % 60 AS STRING) AS name, CASE WHEN c_custkey % 7 < 3 THEN 'go' ELSE 'java' END AS language, c_nationkey AS owner, n_regionkey FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey),
s AS (SELECT * FROM m WHERE (name, language) IN (SELECT name, language FROM m GROUP BY name, language HAVING count(*) BETWEEN 2 AND 64)),
k AS (SELECT DISTINCT a.name, a.language, a.id FROM s a JOIN s b ON a.name = b.name AND a.language = b.language AND a.id <> b.id AND a.n_regionkey = b.n_regionkey)
SELECT name, language, id FROM (SELECT *, row_number() OVER (PARTITION BY name, language ORDER BY id) AS rn FROM k) WHERE rn <= 8""")
def q_p20_hierarchy_candidates(t):
    language = F.when(F.col("c_custkey") % 7 < 3, "go").otherwise("java")
    methods = t("customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 60).cast("string")).alias("name"), language.alias("language"), F.col("c_nationkey").alias("owner"))
    closure = G.ancestors(t("nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent")))
    return G.hierarchy_candidates(methods, closure)


@_query("""WITH r AS (SELECT src AS id, 1 AS e, 0 AS i, 0 AS s FROM {edges} WHERE source_id = 'py.flask.query'
UNION ALL SELECT symbol_id, 0, 1, 0 FROM {entrypoints} WHERE kind = 'http_route' UNION ALL SELECT id, 0, 0, 1 FROM {symbols} WHERE kind = 'class')
SELECT id, max(e) = 1 AS explicit, max(i) = 1 AND max(e) = 0 AS implicit, max(s) = 1 AS spec FROM r GROUP BY 1""")
def q_p12_source_ids(t):
    return G.source_ids(t("edges"), t("entrypoints"), t("symbols").where("kind = 'class'"), ["py.flask.query"], ["http_route"])


@_query("SELECT DISTINCT dst AS id FROM {edges} WHERE sink_id = 'py.sql-execute' AND dst IS NOT NULL UNION SELECT id FROM {symbols} WHERE kind = 'module'")
def q_p13_sink_ids(t):
    return G.sink_ids(t("edges"), t("symbols").where("kind = 'module'"), ["py.sql-execute"])


_DIRECT = "SELECT DISTINCT src, dst FROM {edges} WHERE dst IS NOT NULL AND kind = 'calls' AND confidence >= 1 AND via IS DISTINCT FROM 'cha' AND src <> dst"


@_query(f"""SELECT id, 'center' AS role, qname FROM {{symbols}} WHERE id = 1009
UNION ALL (SELECT id, 'caller', qname FROM {{symbols}} WHERE id IN (SELECT src FROM ({_DIRECT}) WHERE dst = 1009) ORDER BY qname, id LIMIT 20)
UNION ALL (SELECT id, 'callee', qname FROM {{symbols}} WHERE id IN (SELECT dst FROM ({_DIRECT}) WHERE src = 1009) ORDER BY qname, id LIMIT 20)""".replace("{{", "{").replace("}}", "}"))
def q_p18_graph_view(t):
    return G.around(_ids(t, 1009), t("symbols"), G.adjacency(t("edges"), ("calls",)), 20)


# Catalogs, frameworks and searches


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int | float) else _text(x) for x in r) + ")" for r in rows) + f") v({names}))"


_ENTRIES = _values([(k, i, e.id, e.category, e.severity, e.pattern, e.hint, e.channel) for k, of in (("sink", C.BUILTIN.sinks), ("source", C.BUILTIN.sources)) for i, e in enumerate(of)], "kind, ord, id, category, severity, pattern, hint, channel")


def _asked(f, sql: str, name: str):
    """Register a query whose SQL is not a template, as patterns hold braces."""
    _QUERIES[name] = lambda spark, d: f(lambda n: view(spark, d, n))
    _ORACLES[name] = sql


_asked(lambda t: C.as_rows(t("region").sparkSession), f"SELECT * FROM {_ENTRIES}", "a12_catalog")
_asked(lambda t: C.as_rows(t("region").sparkSession).groupBy("kind", "category").agg(F.count(F.lit(1)).alias("entries")), f"SELECT kind, category, count(*) AS entries FROM {_ENTRIES} GROUP BY 1, 2", "g6_categories")


def _first_fit(entries, alias: str) -> str:
    """SQL: the id of the first entry that fits, tried one by one."""
    tests = [f"WHEN regexp_matches(dst_qname, {_text(P.catalog_regex(e.pattern))})" + (f" AND coalesce(arg_preview, '') <> '' AND regexp_matches(arg_preview, {_text(e.hint)})" if e.hint else "") + f" THEN {_text(e.id)}" for e in entries]
    return f"CASE WHEN kind <> 'calls' THEN NULL {' '.join(tests)} END AS {alias}"


_asked(
    lambda t: C.stamped(t("calls")).select("id", "sink_id", "source_id", "source_key"),
    f"""SELECT id, sink_id, source_id, CASE WHEN source_id IS NOT NULL AND regexp_matches(arg_preview, '["''][^"'']*["'']') THEN substr(regexp_extract(arg_preview, '["'']([^"'']*)["'']', 1), 1, 128) END AS source_key
FROM (SELECT id, arg_preview, {_first_fit(C.BUILTIN.sinks, "sink_id")}, {_first_fit(C.BUILTIN.sources, "source_id")} FROM ({duckdb_sql("SELECT * FROM {calls}")}))""",
    "h22_stamped_calls",
)

_SIGNALS = _values([(n, la, i, k, P.catalog_regex(p.lower() if k == "dependency" else p), w) for n, la, i, k, p, w in FW.signal_rows()], "framework, language, ord, kind, rx, weight")


def _detected(t):
    out = FW.detected(t("region").sparkSession, t("facts"), t("present"))
    return out.select("repo_id", "framework", "language", "confidence", F.array_join("evidence", "|").alias("evidence"))


_asked(
    _detected,
    f"""SELECT repo_id, framework, language, round(1 - product(1 - weight), 3) AS confidence, string_agg(evidence, '|' ORDER BY ord) AS evidence FROM (
SELECT f.repo_id, s.framework, s.language, s.ord, CAST(s.weight AS DOUBLE) AS weight, min(CASE WHEN f.kind = 'dependency' THEN lower(value) ELSE value END) AS evidence
FROM ({duckdb_sql("SELECT * FROM {facts}")}) f JOIN {_SIGNALS} s ON s.kind = f.kind AND regexp_matches(CASE WHEN f.kind = 'dependency' THEN lower(value) ELSE value END, s.rx)
AND (f.kind IN ('file', 'symbol') OR f.language = s.language OR (f.kind = 'import' AND s.language = 'javascript' AND f.language IN ('typescript', 'tsx')))
WHERE EXISTS (SELECT 1 FROM ({duckdb_sql("SELECT * FROM {present}")}) p WHERE p.repo_id = f.repo_id AND p.language = s.language) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3 HAVING 1 - product(1 - weight) >= 0.5""",
    "d1_frameworks",
)

_ENV = ", ".join(_text(i) for i in C.BUILTIN.ids("sources", "env_input"))
_SQL_SINKS = ", ".join(_text(i) for i in C.BUILTIN.ids("sinks", "sql"))
_EVERY = ", ".join(_text(i) for i in C.BUILTIN.ids("sinks", "all"))


def _search_sql(starts: str, goals: str, tagged: str, edge: str, open_: str, k: int, depth: int) -> str:
    severity = "CASE sink_id " + " ".join(f"WHEN {_text(e.id)} THEN {G.SEVERITY.index(e.severity)}" for e in C.BUILTIN.sinks) + f" ELSE {len(G.SEVERITY)} END"
    return duckdb_sql(f"""WITH RECURSIVE e AS (SELECT * FROM {{edges}} WHERE dst IS NOT NULL AND {edge}), s AS ({starts}), g AS ({goals}),
w(nodes, edge_ids, node, sink_id, low, arg) AS (SELECT [e.src, e.dst], [e.id], e.dst, e.sink_id, e.confidence, e.arg_preview FROM e JOIN s ON s.id = e.src WHERE e.src <> e.dst
UNION ALL SELECT list_append(w.nodes, e.dst), list_append(w.edge_ids, e.id), e.dst, e.sink_id, least(w.low, e.confidence), e.arg_preview
FROM w JOIN e ON e.src = w.node WHERE NOT list_contains(w.nodes, e.dst) AND len(w.edge_ids) < {depth} AND w.node NOT IN (SELECT id FROM g)),
p AS (SELECT * FROM w WHERE node IN (SELECT id FROM g) AND {tagged} ORDER BY len(nodes), nodes, edge_ids LIMIT {max(4 * k, 64)}),
o AS (SELECT DISTINCT src FROM {{edges}} WHERE dst IS NOT NULL AND {open_})
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(edge_ids, '>') AS edge_ids, low AS min_confidence, sink_id, arg = '("select 1")' AS constant_args,
EXISTS (SELECT 1 FROM o WHERE list_contains(p.nodes, o.src)) AS may_continue FROM p ORDER BY {severity}, low DESC, len(nodes), nodes, edge_ids LIMIT {k}""")


def _shown(found: S.Paths):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ">").alias(c)
    return found.rows.select(join("nodes"), join("edge_ids"), "min_confidence", "sink_id", "constant_args", "may_continue")


_USABLE = "kind = 'calls' AND confidence >= 1 AND via IS DISTINCT FROM 'cha'"
_asked(
    lambda t: _shown(S.search(t("edges"), t("symbols"), t("entrypoints"), source_category="env_input", sink_category="sql", max_depth=4, max_paths=20)),
    _search_sql(f"SELECT DISTINCT src AS id FROM {{edges}} WHERE source_id IN ({_ENV})", f"SELECT DISTINCT dst AS id FROM {{edges}} WHERE sink_id IN ({_SQL_SINKS}) AND dst IS NOT NULL", f"sink_id IN ({_SQL_SINKS})", _USABLE, "kind = 'calls' AND (confidence < 1 OR via IN ('cha', 'dynamic'))", 20, 4),
    "p10_search",
)
_asked(
    lambda t: _shown(S.search(t("edges"), t("symbols"), t("entrypoints"), source=["NATION_4.HOUSEHOLD.*", "NATION_2.BUILDING.Customer#00000000*"], sink="AFRICA.NATION_0", include_fuzzy=True, include_unresolved=True, include_callbacks=True, max_depth=4, max_paths=5)),
    _search_sql("SELECT id FROM {symbols} WHERE qname ILIKE 'NATION@_4.HOUSEHOLD.%' ESCAPE '@' OR qname ILIKE 'NATION@_2.BUILDING.Customer#00000000%' ESCAPE '@'", "SELECT id FROM {symbols} WHERE qname = 'AFRICA.NATION_0'", "TRUE", "kind IN ('calls', 'callback')", "kind IN ('calls', 'callback') AND via = 'dynamic'", 5, 4),
    "p11_explicit_search",
)
_asked(
    lambda t: _shown(S.search(t("edges"), t("symbols"), t("entrypoints"), source_category="cli_arg", sink_category="all", max_depth=3, max_paths=10, strict=True)),
    _search_sql("SELECT DISTINCT symbol_id AS id FROM {entrypoints} WHERE kind IN ('cli_command', 'main')", f"SELECT DISTINCT dst AS id FROM {{edges}} WHERE sink_id IN ({_EVERY}) AND dst IS NOT NULL", f"sink_id IN ({_EVERY})", _USABLE, "kind = 'calls' AND (confidence < 1 OR via IN ('cha', 'dynamic'))", 10, 3),
    "p11_handlers_search",
)
_asked(
    lambda t: S.symbol_ids(t("symbols"), ["Brand#11.*", "ASIA"], bare=True),
    duckdb_sql("SELECT id FROM {symbols} WHERE qname ILIKE 'Brand#11.%' OR qname = 'ASIA'"),
    "f9_spec_ids",
)


# References to edges

_STAR_SINK = "CASE " + " ".join(f"WHEN regexp_matches(star, {_text(P.catalog_regex(e.pattern))})" + (f" AND coalesce(arg_preview, '') <> '' AND regexp_matches(arg_preview, {_text(e.hint)})" if e.hint else "") + " THEN TRUE" for e in C.BUILTIN.sinks if e.pattern.startswith("py:") or ":" not in e.pattern) + " ELSE FALSE END"
_RESOLVE_VIEWS = "WITH " + ", ".join(f"{n} AS ({duckdb_sql('SELECT * FROM {' + n + '}')})" for n in ("defs", "refs", "brings", "lines", "typed"))
_RESOLVED = f"""{_RESOLVE_VIEWS},
q AS (SELECT qname, max(id) AS id FROM defs GROUP BY 1), x AS (SELECT DISTINCT qname FROM defs WHERE kind = 'module'),
r AS (SELECT *, {_STAR_SINK} AS sinkish FROM (SELECT *, split_part(split_part(callee_text, '.', 1), '(', 1) AS first, contains(callee_text, '(') AS chained, prefix || ':*.' || callee_name AS star FROM refs)),
im AS (SELECT file_id, alias, arg_max(target, ordinal) AS target FROM brings WHERE NOT wildcard GROUP BY 1, 2),
fn AS (SELECT name, language, CASE WHEN kind = 'method' THEN 'm' ELSE 'f' END AS g, count(*) AS n, min(id) AS id, arg_min(qname, id) AS qname FROM defs WHERE kind IN ('method', 'function', 'class') GROUP BY 1, 2, 3),
cb AS (SELECT name, language, count(*) AS n, min(id) AS id, arg_min(qname, id) AS qname FROM defs WHERE kind IN ('method', 'function') GROUP BY 1, 2),
ex AS (SELECT ref_id, target || substr(callee_text, length(first) + 1) AS e FROM r JOIN im ON im.file_id = r.file_id AND im.alias = r.first WHERE NOT chained AND kind NOT IN ('callback', 'dynamic_call')),
ix AS (SELECT ref_id, e, EXISTS (SELECT 1 FROM x WHERE e = x.qname OR starts_with(e, x.qname || '.')) AS own FROM ex),
c AS (
SELECT ref_id, 0 AS rank, 0 AS o, q.id AS dst, type || '.' || callee_name AS dst_qname, 2 AS confidence, 'binding' AS via FROM r JOIN typed ON typed.caller = r.caller AND typed.name = r.receiver JOIN q ON q.qname = type || '.' || callee_name WHERE NOT sinkish AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 0, 1, NULL, type || '.' || callee_name, 2, 'binding' FROM r JOIN typed ON typed.caller = r.caller AND typed.name = r.receiver WHERE contains(type, ':') AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 1, 0, q.id, e, 2, NULL FROM ix JOIN q ON q.qname = e WHERE own
UNION ALL SELECT ref_id, 1, 2, NULL, e, 0, NULL FROM ix WHERE own
UNION ALL SELECT ref_id, 1, 0, NULL, 'py:' || e, 2, NULL FROM ix WHERE NOT own
UNION ALL SELECT ref_id, 2, 0, q.id, q.qname, 3, NULL FROM r JOIN q ON q.qname = module || '.' || callee_name WHERE receiver IS NULL AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 3, 0, q.id, q.qname, 3, NULL FROM r JOIN q ON q.qname = owner || '.' || callee_name WHERE receiver = 'self' AND owner IN (SELECT qname FROM defs WHERE kind = 'class') AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 3, depth, q.id, q.qname, 3, NULL FROM r JOIN lines ON lines.id = owner JOIN q ON q.qname = ancestor || '.' || callee_name WHERE receiver = 'self' AND owner IN (SELECT qname FROM defs WHERE kind = 'class') AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 4, ordinal, q.id, q.qname, 2, NULL FROM r JOIN brings ON wildcard AND brings.file_id = r.file_id JOIN q ON q.qname = target || '.' || callee_name WHERE receiver IS NULL AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 5, 0, fn.id, fn.qname, 1, NULL FROM r JOIN fn ON fn.name = callee_name AND fn.language = r.language AND n = 1 AND g = CASE WHEN receiver IS NULL THEN 'f' ELSE 'm' END WHERE (receiver IS NULL OR NOT sinkish) AND kind NOT IN ('callback', 'dynamic_call')
UNION ALL SELECT ref_id, 2, 0, q.id, q.qname, 2, NULL FROM r JOIN q ON q.qname = module || '.' || callee_name WHERE kind = 'callback'
UNION ALL SELECT ref_id, 3, 0, q.id, q.qname, 2, NULL FROM r JOIN im ON im.file_id = r.file_id AND im.alias = callee_name JOIN q ON q.qname = target WHERE kind = 'callback'
UNION ALL SELECT ref_id, 4, 0, cb.id, cb.qname, 2, NULL FROM r JOIN cb ON cb.name = callee_name AND cb.language = r.language AND n = 1 WHERE kind = 'callback'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY rank, o, dst_qname) AS rn FROM c) WHERE rn = 1)
SELECT r.ref_id, CASE kind WHEN 'inherit' THEN 'inherits' WHEN 'callback' THEN 'callback' ELSE 'calls' END AS kind, b.dst,
CASE WHEN b.ref_id IS NOT NULL THEN b.dst_qname WHEN kind = 'dynamic_call' THEN CASE WHEN callee_name = '<dynamic>' THEN 'py:<dynamic>' ELSE 'py:' || callee_name || '.*' END WHEN receiver IS NOT NULL OR chained THEN star ELSE 'py:' || callee_text END AS dst_qname,
coalesce(b.confidence, 0) AS confidence, CASE WHEN b.ref_id IS NOT NULL THEN b.via WHEN kind = 'dynamic_call' THEN 'dynamic' END AS via
FROM r LEFT JOIN b ON b.ref_id = r.ref_id WHERE kind <> 'callback' OR b.ref_id IS NOT NULL"""


def _resolved(t):
    return RS.resolve(t("refs"), t("brings"), t("defs"), t("lines"), bindings=t("typed"))


_asked(lambda t: _resolved(t).select("ref_id", "kind", "dst", "dst_qname", "confidence", "via"), _RESOLVED, "h10_resolved_references")
_asked(lambda t: RS.mint_externals(_resolved(t), t("defs")), f"SELECT DISTINCT dst_qname AS qname, regexp_extract(dst_qname, '([^.:]*)$', 1) AS name FROM ({_RESOLVED}) WHERE dst IS NULL AND dst_qname NOT IN (SELECT qname FROM ({duckdb_sql('SELECT * FROM {defs}')}))", "h20_externals")
_asked(
    lambda t: RS.import_edges(t("brings").withColumnRenamed("target", "module").withColumn("prefix", F.lit("py")).withColumn("line", F.col("ordinal") + 1), t("defs")),
    f"""{_RESOLVE_VIEWS}, f AS (SELECT file_id, target AS module, min(ordinal) + 1 AS line FROM brings GROUP BY 1, 2), o AS (SELECT *, EXISTS (SELECT 1 FROM defs x WHERE kind = 'module' AND (module = x.qname OR starts_with(module, x.qname || '.'))) AS own FROM f),
q AS (SELECT qname, max(id) AS id FROM defs GROUP BY 1)
SELECT file_id, CASE WHEN own THEN id END AS dst, CASE WHEN own THEN module ELSE 'py:' || module END AS dst_qname, line, CASE WHEN own AND id IS NULL THEN 0 ELSE 2 END AS confidence FROM o LEFT JOIN q ON q.qname = module""",
    "h8_import_edges",
)
_asked(
    lambda t: RS.parents(t("defs")),
    f"""{_RESOLVE_VIEWS}, s AS (SELECT id, file_id, regexp_extract(qname, '^(.*)\\.[^.]*$', 1) AS up FROM defs WHERE kind <> 'module')
SELECT s.id, coalesce((SELECT max(id) FROM defs d WHERE d.qname = up AND d.file_id = s.file_id), (SELECT max(id) FROM defs d WHERE d.qname = up), (SELECT max(id) FROM defs d WHERE d.kind = 'module' AND d.file_id = s.file_id)) AS parent FROM s""",
    "h0_parents",
)


def _handlers(t):
    hints = t("hops").select(F.col("id").alias("hint_id"), (F.col("src") % 8 + 1).alias("file_id"), F.expr("CASE WHEN id % 3 = 0 THEN 'ASIA.NATION_' || CAST(dst % 30 AS STRING) WHEN id % 3 = 1 THEN 'AFRICA.only' || CAST(dst % 3 AS STRING) END").alias("handler"), "line")
    edges = t("hops").select((F.col("src") % 8 + 1).alias("file_id"), "kind", F.lit(7).alias("line"), "dst")
    return RS.bound_handlers(hints, t("defs"), edges)


_asked(
    _handlers,
    f"""{_RESOLVE_VIEWS}, h AS (SELECT id AS hint_id, src % 8 + 1 AS file_id, CASE WHEN id % 3 = 0 THEN 'ASIA.NATION_' || CAST(dst % 30 AS STRING) WHEN id % 3 = 1 THEN 'AFRICA.only' || CAST(dst % 3 AS STRING) END AS handler, line FROM ({duckdb_sql('SELECT * FROM {hops}')})),
n AS (SELECT file_id, qname, max(id) AS id FROM defs GROUP BY 1, 2), f AS (SELECT qname, max(id) AS id FROM defs GROUP BY 1), m AS (SELECT file_id, max(id) AS id FROM defs WHERE kind = 'module' GROUP BY 1),
b AS (SELECT src % 8 + 1 AS file_id, 7 AS line, min(dst) AS dst FROM ({duckdb_sql('SELECT * FROM {hops}')}) WHERE kind = 'callback' GROUP BY 1)
SELECT hint_id, coalesce(n.id, f.id, b.dst, m.id) AS symbol_id FROM h LEFT JOIN n ON n.file_id = h.file_id AND n.qname = handler LEFT JOIN f ON f.qname = handler LEFT JOIN b ON b.file_id = h.file_id AND b.line = h.line LEFT JOIN m ON m.file_id = h.file_id""",
    "h23_bound_handlers",
)


# Entrypoints by rule


def _rule_sql(r: EP.Rule) -> str:
    """SQL for what one rule tells of all facts of its kind."""
    call = r.on == "call"
    text, args = ("callee", "('(' || regexp_replace(args, '^\\(+', ''))") if call else ("text", "text")
    string = f"CASE WHEN regexp_matches({args}, {_text(EP.STRING)}) THEN regexp_extract({args}, {_text(EP.STRING)}, 1) END"
    where = [f"language IN ({', '.join(map(_text, r.languages))})", f"regexp_matches({text}, {_text(r.text)})"]
    where += [] if call else ["kind IN ('function', 'method', 'struct')"]
    where += [f"regexp_matches(receiver, {_text(r.receiver)})"] if r.receiver else []
    where += [f"NOT coalesce(regexp_matches(receiver, {_text(r.not_receiver)}), FALSE)"] if r.not_receiver else []
    where += [f"({string}) IS NOT NULL"] if r.route in ("any", "/") else []
    where += [f"starts_with({string}, '/')"] if r.route == "/" else []
    listed = f"list_aggregate(list_transform(regexp_extract_all(regexp_extract({args}, 'methods\\s*=\\s*[\\[(]([^\\])]*)', 1), '[\"'']([A-Za-z]+)[\"'']', 1), lambda x: upper(x)), 'string_agg', ',')"
    methods = {None: "NULL", "keyword": f"coalesce(nullif({listed}, ''), 'GET')", "group": f"upper(regexp_extract({text}, {_text(r.text)}, 1))", "name": f"upper(regexp_replace({text}, '^(?:add_|do)', ''))", "*": "'*'"}[r.methods]
    route = f"coalesce({string}, '')" if r.route == "maybe" and call else string if r.route else "NULL"
    last, given = f"regexp_extract(args, {_text(EP.LAST_NAME)}, 1)", "regexp_extract(args, '(?:view_func\\s*=\\s*|,\\s*)([A-Za-z_]\\w*)\\s*\\)?\\s*$', 1)"
    handler = {"own": "caller", "none": "NULL", "last": f"CASE WHEN {last} <> '' THEN module || '.' || {last} ELSE caller END", "argument": f"CASE WHEN {given} <> '' THEN module || '.' || {given} END"}[r.handler] if call else "qname"
    name = ("NULL" if r.kind == "http_route" else f"coalesce({string}, callee)") if call else f"coalesce({string}, name)" if r.kind == "cli_command" else "name"
    return f"SELECT file_id, line, {_text(r.id)} AS rule, {_text(r.framework)} AS framework, {_text(r.kind)} AS kind, {handler} AS handler, {route} AS route, {methods} AS methods, {name} AS name FROM f WHERE {' AND '.join(where)}"


for _on, _facts, _name in (("decorator", "decorators", "n_decorator_rules"), ("call", "registered", "n_call_rules")):
    _asked(
        lambda t, on=_on, facts=_facts: EP.hints(t(facts), on),
        f"WITH f AS ({duckdb_sql('SELECT * FROM {' + _facts + '}')}) " + " UNION ALL ".join(_rule_sql(r) for r in EP.RULES if r.on == _on),
        _name,
    )

_SURE = (("flask", 0.94), ("fastapi", 0.94), ("click", 0.7), ("sanic", 0.8))
_asked(
    lambda t: EP.best_hints(EP.hints(t("decorators"), "decorator"), t("region").sparkSession.createDataFrame(list(_SURE), "framework string, confidence double")).drop("file_id", "line"),
    f"""WITH f AS ({duckdb_sql("SELECT * FROM {decorators}")}), h AS ({" UNION ALL ".join(_rule_sql(r) for r in EP.RULES if r.on == "decorator")})
SELECT rule, h.framework, kind, handler, route, methods, name FROM (SELECT h.*, row_number() OVER (PARTITION BY kind, handler, route, methods ORDER BY coalesce(c.confidence, 0) DESC, CASE WHEN h.framework = 'fastapi' THEN 1 ELSE 0 END DESC, file_id, line, rule) AS rn
FROM h LEFT JOIN {_values(_SURE, "framework, confidence")} c ON c.framework = h.framework) h WHERE rn = 1""",
    "k4_best_hints",
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best source-to-sink paths."""
    return _QUERIES["r1_ranked_paths"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
