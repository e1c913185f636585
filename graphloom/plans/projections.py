"""Code-graph tables as projections of the star-schema test tables.

Each is one SQL text that Spark and DuckDB both run; ``{name}`` is a table or
another projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

VIEWS = {
    "files": """
SELECT doc_id + 1 AS id, CAST(substr(source, 4) AS INT) + 1 AS repo_id, source || '/' || CAST(doc_id AS STRING) AS path,
       lang AS language, md5(text) AS content_hash, n_chars AS size_bytes,
       CASE WHEN n_chars > 10000 THEN 'too_large' END AS skip_reason
FROM {documents}""",
    "symbols": """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 'module' AS kind, r_name AS name, r_name AS qname, CAST(NULL AS BIGINT) AS parent_id, CAST(r_regionkey + 1 AS BIGINT) AS file_id, 1 AS start_line, 900 AS end_line FROM {region}
UNION ALL
SELECT CAST(n_nationkey + 100 AS BIGINT), 'class', n_name, r_name || '.' || n_name, CAST(n_regionkey + 1 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), 10 * n_nationkey + 1, 10 * n_nationkey + 9 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT s_suppkey + 1000, 'function', s_name, n_name || '.' || s_name, CAST(s_nationkey + 100 AS BIGINT), CAST(s_suppkey % 50 + 1 AS BIGINT), CAST(s_suppkey % 90 * 5 + 1 AS INT), CAST(s_suppkey % 90 * 5 + 4 AS INT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT c_custkey + 1000000, 'method', c_name, n_name || '.' || c_mktsegment || '.' || c_name, CAST(c_nationkey + 100 AS BIGINT), CAST(c_custkey % 50 + 1 AS BIGINT), CAST(c_custkey % 200 * 4 + 1 AS INT), CAST(c_custkey % 200 * 4 + 30 AS INT) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT p_partkey + 5000000, 'external', p_name, 'py:' || p_brand || '.' || p_name, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 1, 1 FROM {part}
UNION ALL
SELECT o_orderkey + 10000000, 'function', 'o' || CAST(o_orderkey AS STRING), 'orders.o' || CAST(o_orderkey AS STRING), CAST(NULL AS BIGINT), CAST(o_orderkey % 200 + 1 AS BIGINT), 1, 9 FROM {orders}""",
    "edges": """
SELECT 1000000000 + o_orderkey AS id, 'calls' AS kind, 1000000 + o_custkey AS src, 10000000 + o_orderkey AS dst, 'orders.o' || CAST(o_orderkey AS STRING) AS dst_qname, 1 AS line, 3 AS confidence, CAST(NULL AS STRING) AS via, CAST(NULL AS STRING) AS sink_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'py.flask.query' WHEN '2-HIGH' THEN 'py.env' END AS source_id, '(' || o_orderstatus || ', "k")' AS arg_preview FROM {orders}
UNION ALL
SELECT 2000000000 + l_orderkey * 8 + l_linenumber, CASE WHEN l_tax > 0.07 THEN 'callback' ELSE 'calls' END, 10000000 + l_orderkey, 1000 + l_suppkey, 's' || CAST(l_suppkey AS STRING), l_linenumber, l_linenumber % 4, CASE l_returnflag WHEN 'A' THEN 'cha' WHEN 'R' THEN 'dynamic' END, CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN l_linestatus = 'O' THEN '("fixed", 1)' ELSE '(cmd, shell=True)' END FROM {lineitem}
UNION ALL
SELECT 3000000000 + s_suppkey, 'calls', 1000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), 'n' || CAST(s_nationkey AS STRING), 2, 2, CAST(NULL AS STRING), CASE WHEN s_nationkey % 3 = 0 THEN 'py.sql-execute' WHEN s_nationkey % 3 = 1 THEN 'py.command-exec.os' END, CAST(NULL AS STRING), '("select 1")' FROM {supplier}
UNION ALL
SELECT CAST(4000000000 + n_nationkey AS BIGINT), 'inherits', CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), 'r' || CAST(n_regionkey AS STRING), 1, 3, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '()' FROM {nation}
UNION ALL
SELECT 5000000000 + l_orderkey * 8 + l_linenumber, 'calls', 10000000 + l_orderkey, CAST(NULL AS BIGINT), 'py:p' || CAST(l_partkey AS STRING), l_linenumber, 0, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '(x)' FROM {lineitem} WHERE l_quantity < 5""",
    # Users and keys of the events: self loops, parallel edges and cycles.
    "hops": """
SELECT event_id + 1 AS id, user_id + 1 AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS dst,
       CASE event_type WHEN 'click' THEN 'calls' WHEN 'view' THEN 'calls' WHEN 'purchase' THEN 'callback' ELSE 'references' END AS kind,
       CAST(event_id % 1000 AS INT) AS line, CAST(event_id % 4 AS INT) AS confidence,
       CASE WHEN event_id % 7 = 0 THEN 'cha' WHEN event_id % 11 = 0 THEN 'dynamic' END AS via
FROM {events}""",
    "entrypoints": """
SELECT page_id + 1 AS id, CASE WHEN url LIKE 'https%' THEN 'http_route' ELSE 'cli_command' END AS kind,
       CASE WHEN url LIKE '%//www.%' THEN 'flask' WHEN url LIKE '%//blog.%' THEN 'express' WHEN url LIKE '%//m.%' THEN 'gin' END AS framework,
       regexp_extract(url, '://[^/]*([^?#]*)', 1) AS route, page_id % 1500 + 1 + 1000000 AS symbol_id,
       CASE WHEN url LIKE '%ref=%' THEN '{{"tainted_params":["ref"]}}' ELSE '{{}}' END AS extra
FROM {pages}""",
    "params": """
SELECT page_id * 2 + 1 AS id, page_id + 1 AS entrypoint_id, 'page' AS name, 'query' AS location FROM {pages} WHERE url LIKE '%page=%'
UNION ALL
SELECT page_id * 2 + 2, page_id + 1, 'ref', 'query' FROM {pages} WHERE url LIKE '%ref=%'""",
}


def _case(by: str, values: list[str | None]) -> str:
    """SQL for the value whose place is the remainder of ``by``."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


#: Callees and arguments that a catalog's patterns and hints tell apart.
CALLEES = ["py:os.system", "py:subprocess.run", "py:*.execute", "py:eval", "py:flask.request.args.get", "py:os.getenv", "js:child_process.exec", "js:*.exec", "java:*.lookup", "rb:*.read", "rb:*.fetch", "go:os/exec.Command", "php:eval", "cs:Process.Start", "rust:std.env.args", "py:app.views.show", "js:fs.readFileSync", "py:hashlib.md5", None]
ARGUMENTS = ["(cmd, shell=True)", "()", '("fixed", 1)', "(name)", "(input)", "(params[:x])", "('q' + x)", None]
#: Facts about repositories: kind, language, value.
FACTS = [
    ("dependency", "python", "Flask"), ("import", "python", "flask"), ("import", "python", "argparse"), ("file", None, "app/manage.py"), ("file", None, "serverless.yml"), ("symbol", None, "lambda_handler"),
    ("dependency", "javascript", "express"), ("import", "typescript", "express"), ("dependency", "javascript", "apollo-server-koa"), ("import", "tsx", "react"), ("dependency", "ruby", "railties"),
    ("import", "ruby", "active_record/base"), ("symbol", None, "ApplicationController"), ("file", None, "config/routes.rb"), ("dependency", "go", "github.com/gin-gonic/gin"), ("import", "go", "github.com/gin-gonic/gin"),
    ("dependency", "rust", "tokio"), ("file", None, "gqlgen.yml"), ("dependency", "python", "unknown"), ("import", "python", "django"), ("file", None, "shop/urls.py"), ("dependency", "php", "laravel/framework"), ("dependency", "java", "nothing"),
]

VIEWS |= {
    "calls": f"""
SELECT id, src, dst, CASE WHEN id % 9 = 0 THEN 'callback' ELSE 'calls' END AS kind, line, confidence, via,
       {_case("id", CALLEES)} AS dst_qname, {_case(f"CAST(floor(id / {len(CALLEES)}) AS BIGINT)", ARGUMENTS)} AS arg_preview
FROM {{hops}}""",
    "facts": f"""
SELECT DISTINCT user_id % 40 AS repo_id, {_case("event_id", [k for k, _, _ in FACTS])} AS kind, {_case("event_id", [x for _, x, _ in FACTS])} AS language, {_case("event_id", [v for _, _, v in FACTS])} AS value
FROM {{events}} WHERE event_id % 1000 < 150""",
    "present": f"""
SELECT DISTINCT user_id % 40 AS repo_id, {_case("user_id", ["python", "javascript", "ruby", "go", "rust", "php"])} AS language FROM {{events}}""",
}

VIEWS |= {
    "defs": """
SELECT id, qname, name, kind, CASE WHEN id % 13 = 0 THEN 'go' ELSE 'python' END AS language, file_id, start_line FROM {symbols} WHERE kind <> 'external' AND id < 10000000
UNION ALL
SELECT CAST(20000000 + n_nationkey * 10 + k AS BIGINT), r_name || '.' || n_name || '.m' || CAST((n_nationkey + k) % 7 AS STRING), 'm' || CAST((n_nationkey + k) % 7 AS STRING), 'method', 'python', CAST(n_regionkey + 1 AS BIGINT), 5
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2)
UNION ALL
SELECT CAST(21000000 + r_regionkey AS BIGINT), r_name || '.only' || CAST(r_regionkey AS STRING), 'only' || CAST(r_regionkey AS STRING), CASE WHEN r_regionkey % 2 = 0 THEN 'function' ELSE 'method' END, 'python', CAST(r_regionkey + 1 AS BIGINT), 3 FROM {region}""",
    "refs": """
SELECT ref_id, file_id, module, kind, callee_name, receiver, line, module || '.' || nation || '.run' AS caller, module || '.' || nation AS owner, 'python' AS language, 'py' AS prefix, arg_preview,
       CASE WHEN receiver IS NULL THEN CASE WHEN ref_id % 17 = 0 THEN 'ns.' || callee_name ELSE callee_name END WHEN ref_id % 19 = 0 THEN receiver || '(x).' || callee_name ELSE receiver || '.' || callee_name END AS callee_text
FROM (SELECT h.id AS ref_id, h.src % 5 + 1 AS file_id, r_name AS module, 'NATION_' || CAST(h.dst % 25 AS STRING) AS nation, h.line, CASE h.id % 3 WHEN 0 THEN '(q)' WHEN 1 THEN '()' END AS arg_preview,
      CASE WHEN h.id % 10 = 7 THEN 'callback' WHEN h.id % 10 = 8 THEN 'dynamic_call' WHEN h.id % 10 = 9 THEN 'inherit' ELSE 'call' END AS kind,
      CASE h.id % 7 WHEN 0 THEN 'm' || CAST(h.dst % 9 AS STRING) WHEN 1 THEN 'NATION_' || CAST(h.dst % 30 AS STRING) WHEN 2 THEN 'only' || CAST(h.dst % 6 AS STRING) WHEN 3 THEN 'execute' WHEN 4 THEN '<dynamic>' WHEN 5 THEN 'm' || CAST(h.src % 7 AS STRING) ELSE 'f' || CAST(h.dst % 50 AS STRING) END AS callee_name,
      CASE CAST(floor(h.id / 7) AS BIGINT) % 6 WHEN 2 THEN 'self' WHEN 3 THEN 'obj' WHEN 4 THEN 'svc' WHEN 5 THEN 'pool' END AS receiver
      FROM {hops} h JOIN {region} ON r_regionkey = h.src % 5)""",
    "brings": """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS file_id, o AS ordinal, CASE o WHEN 0 THEN 'svc' WHEN 1 THEN 'ns' WHEN 2 THEN 'only2' WHEN 3 THEN 'svc' ELSE '*' END AS alias,
       CASE o WHEN 0 THEN 'os.path' WHEN 1 THEN 'ASIA' WHEN 2 THEN 'ASIA.only2' WHEN 3 THEN CASE WHEN r_regionkey < 3 THEN 'EUROPE.NATION_3' ELSE 'urllib.request' END WHEN 4 THEN 'AFRICA' ELSE 'AMERICA' END AS target, o > 3 AS wildcard
FROM {region} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5)""",
    "lines": """
SELECT a.r_name || '.' || x.n_name AS id, b.r_name || '.' || y.n_name AS ancestor, CASE WHEN y.n_nationkey - x.n_nationkey = 5 THEN 1 ELSE 2 END AS depth
FROM {nation} x JOIN {region} a ON x.n_regionkey = a.r_regionkey JOIN {nation} y ON y.n_nationkey - x.n_nationkey IN (5, 10) JOIN {region} b ON y.n_regionkey = b.r_regionkey""",
    "typed": """
SELECT r_name || '.NATION_' || CAST(k AS STRING) || '.run' AS caller, 'pool' AS name, CASE WHEN k % 3 = 0 THEN 'py:db.Pool' ELSE 'ASIA.NATION_2' END AS type
FROM {region} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 7 UNION ALL SELECT 12)""",
}

#: Decorators and registering calls: language, text; language, callee, receiver, arguments.
DECORATORS = [
    ("python", '@app.route("/a", methods=["GET", "post"])'), ("python", "@bp.route('/b')"), ("python", "@router.get('/c/:id')"), ("python", '@mock.patch("a.b.c")'), ("python", "@click.command()"), ("python", "@cli.group"),
    ("python", "@shared_task"), ("python", "@app.task(bind=True)"), ("python", "@app.before_request"), ("python", "@app.middleware('http')"), ("python", "@view_config(route_name='x')"), ("python", "@dramatiq.actor"),
    ("python", "@dag"), ("python", "@routes.post('/d')"), ("python", "@property"), ("rust", "#[tokio::main]"), ("rust", "#[derive(Debug, Parser)]"), ("rust", '#[get("/e")]'), ("go", "@app.route('/no')"),
]
CALLS = [
    ("javascript", "get", "app", "('/x', show)"), ("typescript", "post", "router", "('/y', (req) => 1)"), ("javascript", "get", "axios", "('/z')"), ("javascript", "get", None, "('/w', h)"), ("javascript", "use", "app", "('/m', mw)"),
    ("javascript", "on", "socket", "('join', f)"), ("javascript", "handle", "ipcMain", "('open', f)"), ("go", "HandleFunc", "http", '("/h", serve)'), ("go", "Handle", "mux", '("/h", serve)'),
    ("python", "add_url_rule", "app", '("/u", view_func=show)'), ("python", "add_get", "router", "('/v', show)"), ("python", "add_route", "router", "(x, y)"), ("javascript", "delete", "map", "('key')"), ("go", "HandleFunc", "http", "()"),
]
VIEWS |= {
    "decorators": f"""
SELECT id, CAST(src AS BIGINT) AS file_id, line, {_case("id", [x for x, _ in DECORATORS])} AS language, {_case("id", [x for _, x in DECORATORS])} AS text,
       'app.v.f' || CAST(dst AS STRING) AS qname, 'f' || CAST(dst AS STRING) AS name, CASE id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'class' ELSE 'function' END AS kind FROM {{hops}}""",
    "registered": f"""
SELECT id, CAST(src AS BIGINT) AS file_id, line, {_case("id", [c[0] for c in CALLS])} AS language, {_case("id", [c[1] for c in CALLS])} AS callee, {_case("id", [c[2] for c in CALLS])} AS receiver,
       {_case("id", [c[3] for c in CALLS])} AS args, 'app.v' AS module, 'app.v.setup' AS caller FROM {{hops}}""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def duckdb_sql(sql: str) -> str:
    """``sql`` with projections inlined, for DuckDB."""

    def put(m: re.Match) -> str:
        return m[1] if m[1] in TABLES else f"({duckdb_sql(VIEWS[m[1]])})"

    return _NAME.sub(put, sql).replace("{{", "{").replace("}}", "}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or projection over the Parquet tables of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(sql))})
