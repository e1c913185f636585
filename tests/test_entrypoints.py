"""Entrypoint rules on single facts."""

import pytest

from graphloom.operators import entrypoints as EP

SYMBOLS = "file_id int, line int, language string, qname string, name string, kind string, parent string, signature string, modifiers array<string>"


def test_symbols_by_their_shape(spark):
    rows = [
        (1, 1, "go", "main.main", "main", "function", None, "()", []),
        (1, 2, "go", "a.T.main", "main", "method", "a.T", "()", []),
        (2, 1, "java", "A.main", "main", "method", "A", "(String[] args)", ["public", "static"]),
        (2, 2, "java", "A.main", "main", "method", "A", "(String[] args)", ["public"]),
        (2, 3, "java", "S.doGet", "doGet", "method", "S", "(req, res)", []),
        (3, 1, "csharp", "P.Main", "Main", "method", "P", "()", ["static"]),
        (4, 1, "rust", "main", "main", "function", None, "()", []),
        (5, 1, "python", "h.handler", "handler", "function", None, "(event, context)", []),
        (5, 2, "python", "h.handler", "handler", "function", None, "(x)", []),
        (5, 3, "python", "h.handler", "handler", "function", None, None, None),
    ]
    got = {(r["file_id"], r["line"]): (r["rule"], r["kind"], r["methods"]) for r in EP.hints(spark.createDataFrame(rows, SYMBOLS), "symbol").collect()}
    assert got == {
        (1, 1): ("go.core.main", "main", None),
        (2, 1): ("java.core.main", "main", None),
        (2, 3): ("java.servlet.route", "http_route", "GET"),
        (3, 1): ("csharp.core.main", "main", None),
        (4, 1): ("rust.core.main", "main", None),
        (5, 1): ("python.lambda.handler", "lambda_handler", None),
    }


@pytest.mark.parametrize(
    "text, want",
    [
        ('@app.route("/a", methods=["GET", "post"])', {("flask", "/a", "GET,POST"), ("sanic", "/a", "GET,POST"), ("bottle", "/a", "GET,POST")}),
        ("@app.get('/x')", {("flask", "/x", "GET"), ("fastapi", "/x", "GET"), ("sanic", "/x", "GET"), ("bottle", "/x", "GET")}),
        ('@mock.patch("a.b.c")', {("fastapi", "a.b.c", "PATCH"), ("sanic", "a.b.c", "PATCH"), ("bottle", "a.b.c", "PATCH")}),
        ("@property", set()),
    ],
)
def test_routes_of_decorators(spark, text, want):
    df = spark.createDataFrame([(1, 1, "python", "m.f", "f", "function", text)], "file_id int, line int, language string, qname string, name string, kind string, text string")
    assert {(r["framework"], r["route"], r["methods"]) for r in EP.hints(df, "decorator").collect()} == want


def test_only_rules_of_detected_frameworks_speak(spark):
    df = spark.createDataFrame([(1, 1, "python", "m.f", "f", "function", "@app.get('/x')"), (2, 1, "rust", "m.g", "g", "function", "#[tokio::main]")], "file_id int, line int, language string, qname string, name string, kind string, text string")
    known = spark.createDataFrame([("fastapi",)], "framework string")
    found = EP.hints(df, "decorator", detected=known)
    assert sorted((r["rule"], r["handler"]) for r in found.collect()) == [("python.fastapi.route", "m.f"), ("rust.core.main", "m.g")]
    both = EP.hints(df, "decorator", detected=spark.createDataFrame([("fastapi",), ("flask",)], "framework string"))
    sure = spark.createDataFrame([("fastapi", 0.7), ("flask", 0.7)], "framework string, confidence double")
    assert sorted(r["rule"] for r in EP.best_hints(both, sure).collect()) == ["python.fastapi.route", "rust.core.main"]


def test_registering_calls(spark):
    schema = "file_id int, line int, language string, module string, caller string, callee string, receiver string, args string"
    rows = [(1, 1, "javascript", "m", "m.s", "get", "app", "('/x', show)"), (1, 2, "javascript", "m", "m.s", "get", "axios", "('/x', show)"), (1, 3, "go", "m", "m.s", "HandleFunc", "http", '("/h", serve)'), (1, 4, "python", "m", "m.s", "add_url_rule", "app", '("/u", view_func=show)')]
    got = {(r["line"], r["framework"]): (r["handler"], r["route"], r["methods"]) for r in EP.hints(spark.createDataFrame(rows, schema), "call").collect()}
    assert got == {**{(1, f): ("m.show", "/x", "GET") for f in ("express", "fastify", "koa", "hono")}, (3, "net/http"): ("m.s", "/h", "*"), (4, "flask"): ("m.show", "/u", "*")}
