"""Walks, manifests, extraction, resolution, dataflow and refresh on small trees."""

import pytest

from graphloom.operators import maintenance, resolve, taint
from graphloom.sources import extract_python, scan, store
from graphloom.streaming import refresh


@pytest.fixture
def tree(tmp_path):
    for path, text in {"app/main.py": "import os\n\n@app.route('/run')\ndef handler(cmd):\n    x = cmd\n    os.system(x)\n", "app/test_main.py": "x = 1\n", "node_modules/a.js": "x", "lib/big.min.js": "x", "tool": "#!/usr/bin/env python3\nprint(1)\n", "img.py": "a\0b", "skip/me.py": "x=1", "notes.txt": "x", "requirements.txt": "Flask>=2\n# no\nrequests\n", "Procfile": "web: python app.py\n"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path)


def test_walk(spark, tree):
    rows = {r["path"]: r for r in scan.walk(spark, tree, scan.ignore_rules(["skip/"])).collect()}
    assert set(rows) == {"app/main.py", "app/test_main.py", "lib/big.min.js", "tool", "img.py"}
    assert [rows[p]["skip_reason"] for p in ("app/main.py", "app/test_main.py", "lib/big.min.js", "img.py")] == [None, "test", "minified", "binary"]
    assert rows["tool"]["language"] == "python" and len(rows["tool"]["content_hash"]) == 32


def test_ignore_rules_last_match_wins(spark):
    rules = scan.ignore_rules(["*.log", "!keep.log", "/build"])
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a/x.log",), ("keep.log",), ("build/x",), ("a/build/x",)], "path string")
    assert [r[0] for r in df.select(scan.ignored(F.col("path"), rules)).collect()] == [True, False, True, False]


def test_manifests_and_configs(spark, tree):
    from pyspark.sql import functions as F

    texts = scan.read_tree(spark, tree).withColumn("content", F.decode("content", "UTF-8"))
    assert {tuple(r) for r in scan.manifests(texts).select("ecosystem", "dependency").collect()} == {("python", "flask"), ("python", "requests")}
    assert [tuple(r) for r in scan.config_entrypoints(texts).collect()] == [("Procfile", "main", "python app.py")]
    assert scan.dependencies("package.json", "{bad") == []


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("requirements-dev.txt", "Typing_Extensions>=4\n-r x.txt\n# no\nflask[async]", ["typing-extensions", "flask"]),
        ("pyproject.toml", '[project]\ndependencies = ["A_b>1"]\n[project.optional-dependencies]\nx = ["c"]\n[tool.poetry.dependencies]\npython = "3"\nd = "1"', ["a-b", "c", "d"]),
        ("package.json", '{"name": "me", "dependencies": {"a": "1"}, "peerDependencies": {"b": "1"}}', ["me", "a", "b"]),
        ("composer.json", '{"require": {"php": "8", "ext-json": "*", "a/b": "1"}}', ["a/b"]),
        ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.0.0\n\tgithub.com/c/d v1 // indirect\n)\nrequire golang.org/x/e v2", ["github.com/a/b", "golang.org/x/e"]),
        ("pom.xml", "<project xmlns='m'><artifactId>me</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies><build><plugins><plugin><artifactId>p</artifactId></plugin></plugins></build></project>", ["g:a"]),
        ("pom.xml", "<project", []),
        ("Cargo.toml", '[dependencies]\na = "1"\n[workspace.dependencies]\nb = "1"\n[target.\'cfg(unix)\'.dependencies]\nc = "1"', ["a", "b", "c"]),
        ("My.csproj", '<PackageReference Include="Foo.Bar" /><Reference Include="Baz, Version=1" />', ["foo.bar", "baz"]),
    ],
)
def test_manifest_formats(name, text, want):
    assert [d for _, d in scan.dependencies(name, text)] == want


def test_gates_and_languages(spark):
    from pyspark.sql import functions as F

    wide = ("x" * 300 + "\n") * 200
    rows = [("a.js", wide), ("a.py", wide), ("b.mts", "x"), ("c.kt", "x"), ("d.gemspec", "x"), ("third_party/e.py", "x"), ("f.py", None)]
    df = spark.createDataFrame([(p, len(t or ""), None if t is None else bytearray(t.encode())) for p, t in rows], "path string, size bigint, content binary")
    language = scan.language_of(F.col("path"), F.lit(""))
    got = {r[0]: r[1:] for r in df.select("path", language, scan.skip_reason(F.col("path"), F.col("size"), F.col("content"), language), scan.pruned(F.col("path"))).collect()}
    assert got == {"a.js": ("javascript", "minified", False), "a.py": ("python", None, False), "b.mts": ("typescript", None, False), "c.kt": ("kotlin", None, False), "d.gemspec": ("ruby", None, False), "third_party/e.py": ("python", None, True), "f.py": ("python", "unreadable", False)}


def test_extract(spark):
    code = 'from .base import Base\nimport os.path as p\nLIMIT = 3\nclass A(Base):\n    """doc"""\n    n: int = 0\n    def go(self, f):\n        run(f, 1)\n        return self.go(f)\n'
    row = extract_python.extract(spark.createDataFrame([("pkg/m.py", code), ("bad.py", "def (")], "path string, content string")).where("parse_ok").head()
    assert [(s["kind"], s["qname"]) for s in row["symbols"]] == [("constant", "pkg.m.LIMIT"), ("class", "pkg.m.A"), ("method", "pkg.m.A.go")]
    assert [(i["alias"], i["level"]) for i in row["imports"]] == [("Base", 1), ("p", 0)]
    assert ("call", "self.go", "pkg.m.A.go") in [(r["kind"], r["callee_text"], r["caller"]) for r in row["refs"]]
    assert "callback" in [r["kind"] for r in row["refs"]]


def test_resolve(spark):
    """Cases as rows: what a reference binds to, how surely, and by which way."""
    symbols = [(1, "app.s", "module"), (2, "app.r", "module"), (3, "x", "module"), (4, "w", "module"), (5, "app.r.A", "class"), (10, "app.s.run", "function"), (11, "app.s.Base.go", "method"), (12, "app.r.local", "function"), (13, "x.lonely", "function"), (14, "w.star", "function"), (15, "app.s.impl.deep", "function"), (16, "x.T.execute", "method"), (17, "x.T.fetch", "method"), (18, "app.s.Pool", "class"), (19, "app.s.Pool.take", "method")]
    symbols = spark.createDataFrame([(i, q, q.rpartition(".")[2], k, "python") for i, q, k in symbols], "id bigint, qname string, name string, kind string, language string")
    imports = spark.createDataFrame([(1, 0, "run", "app.s.run", False), (1, 1, "os", "os", False), (1, 2, "*", "w", True), (1, 3, "s", "app.s", False)], "file_id bigint, ordinal int, alias string, target string, wildcard boolean")
    lines = spark.createDataFrame([("app.r.A", "app.s.Base", 1)], "id string, ancestor string, depth int")
    exports = spark.createDataFrame([("app.s.deep", "app.s.impl.deep")], "name string, target string")
    bindings = spark.createDataFrame([("app.r.f", "pool", "app.s.Pool"), ("app.r.f", "db", "py:db.Conn")], "caller string, name string, type string")
    make = lambda i, kind, text, owner=None: (i, 1, "app.r", kind, text, text.rpartition(".")[2], text.rpartition(".")[0] or None, i, "app.r.f", owner, "python", "py")
    cases = {
        1: (make(1, "call", "run"), (10, "app.s.run", 2, None)),
        2: (make(2, "call", "os.system"), (None, "py:os.system", 2, None)),
        3: (make(3, "call", "local"), (12, "app.r.local", 3, None)),
        4: (make(4, "call", "self.go", "app.r.A"), (11, "app.s.Base.go", 3, None)),
        5: (make(5, "call", "lonely"), (13, "x.lonely", 1, None)),
        6: (make(6, "call", "star"), (14, "w.star", 2, None)),
        7: (make(7, "call", "thing.nope"), (None, "py:*.nope", 0, None)),
        8: (make(8, "dynamic_call", "<dynamic>"), (None, "py:<dynamic>", 0, "dynamic")),
        9: (make(9, "callback", "nowhere"), None),
        10: (make(10, "composite", "run"), (10, "app.s.run", 2, None)),
        11: (make(11, "call", "s.gone"), (None, "app.s.gone", 0, None)),
        12: (make(12, "call", "s.deep"), (15, "app.s.impl.deep", 2, "reexport")),
        13: (make(13, "call", "thing.execute"), (None, "py:*.execute", 0, None)),  # the name is a sink's
        14: (make(14, "call", "thing.fetch"), (17, "x.T.fetch", 1, None)),
        15: (make(15, "call", "self.fetch", "app.r.f"), (17, "x.T.fetch", 1, None)),  # the owner is no class
        16: (make(16, "callback", "run"), (10, "app.s.run", 2, None)),
        17: (make(17, "callback", "os"), None),
        18: (make(18, "dynamic_call", "getattr"), (None, "py:getattr.*", 0, "dynamic")),
        19: (make(19, "call", "pool.take"), (19, "app.s.Pool.take", 2, "binding")),
        20: (make(20, "call", "db.query"), (None, "py:db.Conn.query", 2, "binding")),
        21: (make(21, "call", "os.popen(c).read"), (None, "py:*.read", 0, None)),
    }
    refs = spark.createDataFrame([c[0] for c in cases.values()], "ref_id int, file_id bigint, module string, kind string, callee_text string, callee_name string, receiver string, line int, caller string, owner string, language string, prefix string")
    out = resolve.resolve(refs, imports, symbols, lines, exports, bindings)
    rows = out.collect()
    assert {r["ref_id"]: (r["dst"], r["dst_qname"], r["confidence"], r["via"]) for r in rows} == {i: c[1] for i, c in cases.items() if c[1]}
    assert {r["ref_id"]: r["kind"] for r in rows if r["ref_id"] in (10, 16, 1)} == {10: "references", 16: "callback", 1: "calls"}
    assert {r["qname"] for r in resolve.mint_externals(out, symbols).collect()} >= {"py:os.system", "py:*.nope", "py:<dynamic>"}
    candidates = spark.createDataFrame([("fetch", "python", 17), ("fetch", "python", 30)], "name string, language string, id bigint")
    assert {tuple(r) for r in resolve.hierarchy_edges(refs, out, candidates).collect()} == {(14, 30, 1, "cha")}


@pytest.mark.parametrize(("body", "want"), [("x = a\n    sink(x)", True), ("sink(f'{a}')", True), ("x = 1\n    x += a\n    sink(x)", True), ("b = 2\n    sink(b)", False), ("sink('k')", False), ("other(a)", None), ("for y in a:\n        z = y\n    sink(z)", True)])
def test_taint(body, want):
    assert taint.reaches(taint.function_facts(f"def f(a):\n    {body}\n", "f"), {"a"}, "sink") is want


def test_verdict_is_null_for_other_languages(spark):
    df = spark.createDataFrame([("python", "def f(a):\n  s(a)", "f", ["a"], "s"), ("go", "x", "f", ["a"], "s")], "l string, c string, f string, s array<string>, k string")
    assert [r[0] for r in df.select(taint.verdict("l", "c", "f", "s", "k")).collect()] == [True, None]


def test_store_and_json(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_repo(spark.createDataFrame([(1, "a"), (2, "b")], "repo_id int, v string"), path)
    store.write_repo(spark.createDataFrame([(2, "c")], "repo_id int, v string"), path)
    assert {(r["repo_id"], r["v"]) for r in store.read_repo(spark, path).collect()} == {(1, "a"), (2, "c")}
    assert store.as_json(store.read_repo(spark, path, 1).select("v")).head()[0] == '{"v":"a"}'


def test_refresh_keeps_the_last_generation(spark):
    known = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "path string, generation int, v string")
    batch = spark.createDataFrame([("a", 2, "z", False), ("b", 2, None, True)], "path string, generation int, v string, deleted boolean")
    assert [tuple(r) for r in refresh.merged(known, batch).select("path", "v").collect()] == [("a", "z")]


def test_refresh_follows_a_stream(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "path string, generation int, v string, deleted boolean"
    spark.createDataFrame([("a", 1, "x", False)], schema).coalesce(1).write.parquet(src)
    for more in (None, ("a", 2, "y", False)):
        if more:
            spark.createDataFrame([more], schema).coalesce(1).write.mode("append").parquet(src)
        refresh.follow(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "generation=1")).select("path", "v").collect()] == [("a", "y")]


def test_heal_keeps_other_confidences(spark):
    e = spark.createDataFrame([(1, None, "q", 0), (2, None, "q", 3), (3, 9, "q", 1)], "id int, dst bigint, dst_qname string, confidence int")
    s = spark.createDataFrame([(7, "q")], "id bigint, qname string")
    assert {r["id"]: (r["dst"], r["confidence"]) for r in maintenance.heal(e, s).collect()} == {1: (7, 2), 2: (7, 3), 3: (9, 1)}
