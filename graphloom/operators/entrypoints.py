"""Entrypoints by rule: handlers that a decorator, a registering call or a symbol's own shape gives away.

Rules are rows. Each looks at one kind of fact, and all rules of a kind are one
projection over its table: no joins, no passes of their own. Facts:

- decorators: file_id, language, qname, name, kind and line of a symbol, text of its decorator;
- calls: file_id, language, module, caller, callee, receiver, args, line;
- symbols: file_id, language, qname, name, kind, parent, signature, modifiers (array), line.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import methods_of

#: The first string among a decorator's or call's arguments.
STRING = "\\(\\s*[rbf]*[\"']([^\"']+)[\"']"
#: A name that stands last among the arguments.
LAST_NAME = ",\\s*([A-Za-z_$][\\w$]*)\\s*\\)?\\s*$"
SCRIPT = ("javascript", "typescript", "tsx")


@dataclass(frozen=True)
class Rule:
    """What a fact must look like, and what it tells.

    ``text`` is a regex over the decorator, the callee or the symbol's name;
    where it has a group, ``methods`` "group" takes the method from the last
    one, "keyword" from a methods argument (GET without one), "name" from the
    callee's tail; other texts are the method itself. ``route`` says whether
    the first string must be there ("any"), be a path ("/"), or does not matter.
    """

    id: str
    languages: tuple[str, ...]
    framework: str | None
    kind: str
    on: str
    text: str
    methods: str | None = None
    route: str | None = None
    receiver: str | None = None
    not_receiver: str | None = None
    handler: str = "own"
    also: str | None = None


_PY, _VERBS = ("python",), "get|post|put|delete|patch|head|options"
_CLIENTS = "^\\s*(?:nock|supertest|request|superagent|agent|chai|axios|got|fetch|http|https|fastify)\\b"
#: Rules by fact and language.
RULES = (
    Rule("python.flask.route", _PY, "flask", "http_route", "decorator", "^@(?:\\w+)\\.route\\(", "keyword", "any"),
    Rule("python.flask.route", _PY, "flask", "http_route", "decorator", f"^@\\w+\\.({_VERBS})\\(", "group", "/"),
    Rule("python.flask.add_url_rule", _PY, "flask", "http_route", "call", "^add_url_rule$", "*", "maybe", handler="argument"),
    Rule("python.web.middleware", _PY, "flask", "middleware", "decorator", "^@\\w+\\.(?:before_request|after_request|before_first_request|errorhandler|teardown_request)\\b"),
    Rule("python.web.middleware", _PY, "fastapi", "middleware", "decorator", "^@\\w+\\.middleware\\b"),
    Rule("python.fastapi.route", _PY, "fastapi", "http_route", "decorator", f"^@\\w+\\.({_VERBS})\\(", "group", "any"),
    Rule("python.click.command", _PY, "click", "cli_command", "decorator", "^@(?:click|\\w+)\\.(?:command|group)\\b"),
    Rule("python.typer.command", _PY, "typer", "cli_command", "decorator", "^@(?:click|\\w+)\\.(?:command|group)\\b"),
    Rule("python.celery.task", _PY, "celery", "task", "decorator", "^@(?:shared_task\\b|task\\b|\\w+\\.task\\b)"),
    *(Rule(f"python.{f}.route", _PY, f, "http_route", "decorator", "^@(?:\\w+)\\.route\\(", "keyword", "any") for f in ("sanic", "bottle")),
    *(Rule(f"python.{f}.route", _PY, f, "http_route", "decorator", f"^@\\w+\\.({_VERBS})\\(", "group", "any") for f in ("sanic", "bottle")),
    Rule("python.pyramid.view", _PY, "pyramid", "http_route", "decorator", "^@view_config\\b", None, "maybe"),
    Rule("python.dramatiq.actor", _PY, "dramatiq", "task", "decorator", "^@(?:dramatiq\\.actor|actor)\\b"),
    Rule("python.airflow.task", _PY, "airflow", "task", "decorator", "^@(?:task|dag)\\b"),
    Rule("python.aiohttp.route", _PY, "aiohttp", "http_route", "call", "^add_(?:get|post|put|delete|route)$", "name", "maybe", handler="none"),
    Rule("python.aiohttp.route", _PY, "aiohttp", "http_route", "decorator", f"^@routes\\.({_VERBS})\\(", "group", "any"),
    Rule("python.lambda.handler", _PY, "aws-lambda", "lambda_handler", "symbol", "^(?:lambda_handler|handler)$", also="kind = 'function' AND signature LIKE '%event%' AND signature LIKE '%context%'"),
    *(Rule(f"javascript.{f}.route", SCRIPT, f, "http_route", "call", "^(?:get|post|put|delete|patch|all|options|head)$", "name", "/", ".", _CLIENTS, "last") for f in ("express", "fastify", "koa", "hono")),
    Rule("javascript.express.middleware", SCRIPT, "express", "middleware", "call", "^use$", receiver="."),
    Rule("javascript.socketio.event", SCRIPT, "socket.io", "event_handler", "call", "^(?:on|handle)$", receiver="^(?:io|socket)$"),
    Rule("javascript.electron.ipc", SCRIPT, "electron", "event_handler", "call", "^(?:on|handle)$", receiver="^ipcMain$"),
    Rule("go.core.main", ("go",), None, "main", "symbol", "^main$", also="kind = 'function' AND parent IS NULL"),
    Rule("go.nethttp.route", ("go",), "net/http", "http_route", "call", "^(?:HandleFunc|Handle)$", "*", "any", "^http$"),
    Rule("java.core.main", ("java",), None, "main", "symbol", "^main$", also="kind = 'method' AND array_contains(modifiers, 'static') AND array_contains(modifiers, 'public') AND signature LIKE '%String[]%'"),
    Rule("java.servlet.route", ("java",), "servlet-api", "http_route", "symbol", "^do(?:Get|Post|Put|Delete)$", "name", also="kind = 'method'"),
    Rule("csharp.core.main", ("csharp",), None, "main", "symbol", "^Main$", also="kind = 'method' AND array_contains(modifiers, 'static')"),
    Rule("rust.core.main", ("rust",), None, "main", "symbol", "^main$", also="kind = 'function' AND parent IS NULL"),
    Rule("rust.core.main", ("rust",), None, "main", "decorator", "^#\\[\\s*(?:tokio|actix_web|async_std)::main\\b"),
    Rule("rust.clap.command", ("rust",), "clap", "cli_command", "decorator", "^#\\[\\s*derive\\s*\\(.*\\bParser\\b"),
    *(Rule(f"rust.{f}.route", ("rust",), f, "http_route", "decorator", "^#\\[\\s*(get|post|put|delete|patch|head)\\s*\\(", "group", "any") for f in ("actix-web", "rocket")),
)
_HIT = "struct<rule:string,framework:string,kind:string,handler:string,route:string,methods:string,name:string>"


def _hit(rule: Rule) -> Column:
    """What a rule tells of a fact, or null."""
    text = {"decorator": F.col("text"), "call": F.col("callee"), "symbol": F.col("name")}[rule.on]
    args = {"decorator": F.col("text"), "call": F.concat(F.lit("("), F.regexp_replace("args", "^\\(+", "")) if rule.on == "call" else None, "symbol": F.lit("")}[rule.on]
    found = F.regexp_extract(args, STRING, 1)
    string = F.when(args.rlike(STRING), found)
    fits = F.col("language").isin(*rule.languages) & text.rlike(rule.text)
    if rule.on == "decorator":
        fits = fits & F.col("kind").isin("function", "method", "struct")
    if rule.on == "call" and rule.route:
        fits = fits & (F.coalesce("args", F.lit("")) != "")
    if rule.receiver:
        fits = fits & F.coalesce(F.col("receiver").rlike(rule.receiver), F.lit(False))
    if rule.not_receiver:
        fits = fits & ~F.coalesce(F.col("receiver").rlike(rule.not_receiver), F.lit(False))
    if rule.also:
        fits = fits & F.coalesce(F.expr(rule.also), F.lit(False))
    if rule.route in ("any", "/"):
        fits = fits & string.isNotNull()
    if rule.route == "/":
        fits = fits & string.startswith("/")
    tail = F.upper(F.regexp_replace(text, "^(?:add_|do)", ""))
    listed = F.array_join(methods_of(args), ",")
    methods = {None: F.lit(None).cast("string"), "keyword": F.when(listed != "", listed).otherwise("GET"), "group": F.upper(F.regexp_extract(text, rule.text, 1)) if rule.methods == "group" else None, "name": tail, "*": F.lit("*")}[rule.methods]
    route = F.coalesce(string, F.lit("")) if rule.route == "maybe" and rule.on == "call" else string if rule.route else F.lit(None).cast("string")
    if rule.on == "call":
        last = F.regexp_extract("args", LAST_NAME, 1)
        given = F.regexp_extract("args", "(?:view_func\\s*=\\s*|,\\s*)([A-Za-z_]\\w*)\\s*\\)?\\s*$", 1)
        named = {"own": F.col("caller"), "none": F.lit(None).cast("string"), "last": F.when(last != "", F.concat("module", F.lit("."), last)).otherwise(F.col("caller")), "argument": F.when(given != "", F.concat("module", F.lit("."), given))}[rule.handler]
        name = F.when(F.lit(rule.kind != "http_route"), F.coalesce(string, F.col("callee")))
    else:
        named, name = F.col("qname"), F.coalesce(string, F.col("name")) if rule.kind == "cli_command" else F.col("name")
    return F.when(fits, F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.framework).cast("string").alias("framework"), F.lit(rule.kind).alias("kind"), named.alias("handler"), route.alias("route"), methods.alias("methods"), name.alias("name")).cast(_HIT))


def hints(facts: DataFrame, on: str, rules: Sequence[Rule] = RULES, detected: DataFrame | None = None) -> DataFrame:
    """file_id, line, rule, framework, kind, handler, route, methods, name of every fact of ``facts`` that a rule fits.

    With ``detected`` (framework), rules of other frameworks say nothing.
    """
    own = [r for r in rules if r.on == on]
    out = facts.select("file_id", "line", F.inline(F.array_compact(F.array(*[_hit(r) for r in own]))))
    if detected is None:
        return out
    known = detected.select("framework").distinct()
    return out.where("framework IS NULL").unionByName(out.where("framework IS NOT NULL").join(F.broadcast(known), "framework", "left_semi").select(out.columns))


def best_hints(found: DataFrame, confidence: DataFrame) -> DataFrame:
    """One hint for each (kind, handler, route, methods): that of the surest framework (fastapi first of equals), then the first by file, line and rule.

    ``confidence`` has framework and confidence; a hint without framework has none.
    """
    sure = F.coalesce("confidence", F.lit(0.0))
    keys = [F.coalesce(c, F.lit("\x00")) for c in ("kind", "handler", "route", "methods")]
    w = Window.partitionBy(*keys).orderBy(sure.desc(), F.desc(F.coalesce(F.col("framework") == "fastapi", F.lit(False)).cast("int")), "file_id", "line", "rule")
    ranked = found.join(F.broadcast(confidence.select("framework", "confidence")), "framework", "left").withColumn("__rn", F.row_number().over(w))
    return ranked.where("__rn = 1").select(found.columns)
