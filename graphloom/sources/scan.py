"""Source trees as tables: walk, gates, languages, hashes, manifests."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Language of a file extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "go": "go", "java": "java", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "cs": "csharp", "php": "php", "phtml": "php", "rs": "rust", "graphql": "graphql", "gql": "graphql",
}
#: Languages that are counted but not analysed, by extension.
COUNTED = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala", "hs": "haskell", "lhs": "haskell",
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "ml": "ocaml", "mli": "ocaml", "fs": "fsharp", "fsx": "fsharp", "elm": "elm", "pl": "perl", "pm": "perl",
    "lua": "lua", "r": "r", "jl": "julia", "dart": "dart", "groovy": "groovy", "gradle": "groovy", "vue": "vue", "svelte": "svelte", "zig": "zig", "nim": "nim", "sol": "solidity", "vala": "vala", "hx": "haxe", "cr": "crystal",
    "pas": "pascal", "tcl": "tcl", "ps1": "powershell", "psm1": "powershell", "f90": "fortran", "f95": "fortran", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "html": "html", "css": "css", "scss": "css", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "rst": "restructuredtext", "xml": "xml", "tf": "hcl", "proto": "protobuf",
}
#: Language of a file name.
FILE_NAMES = {"Rakefile": "ruby", "Gemfile": "ruby", "Guardfile": "ruby", "Vagrantfile": "ruby", "Jenkinsfile": "groovy", "Dockerfile": "dockerfile", "Makefile": "make", "BUILD": "starlark", "WORKSPACE": "starlark"}
#: Folders that are never walked, and endings of minified files.
PRUNED = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", ".venv", "venv", ".tox", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", "site-packages", ".eggs", "vendor", "third_party",
    "dist", "build", "target", "out", ".next", ".nuxt", ".gradle", ".idea", ".vscode", "Pods", "DerivedData",
)
MINIFIED = (".min.js", ".min.css", ".bundle.js", ".map")
TEST_FOLDERS = ("test", "tests", "spec", "specs", "__tests__", "testdata", "fixtures")
MAX_BYTES, HEAD_BYTES, MAX_LINE = 2 * 1024 * 1024, 8192, 5000
#: Scripts above so many bytes are minified if their lines have so many characters on average.
WIDE_BYTES, WIDE_LINE = 50 * 1024, 250


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mtime, content) of all files under ``root``, paths from there."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z]+:/*", "/"), "^" + re.escape("/" + base.lstrip("/")) + "/", "")
    return df.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def language_of(path: Column, head: Column) -> Column:
    """By extension, then by file name, then by the first line of a file without extension."""
    name = F.element_at(F.split(path, "/"), -1)
    by = F.create_map(*[F.lit(x) for kv in (EXTENSIONS | COUNTED).items() for x in kv])
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, "\\."), -1)))
    shebang = F.regexp_extract(head, "^#!.*?\\b(python|node|ruby|php)", 1)
    return F.coalesce(F.element_at(by, extension), F.element_at(F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv]), name), F.when(extension.isNull(), F.element_at(F.create_map(*[F.lit(x) for x in ("python", "python", "node", "javascript", "ruby", "ruby", "php", "php")]), F.when(shebang != "", shebang))))


def skip_reason(path: Column, size: Column, content: Column, language: Column, include_tests: bool = False) -> Column:
    """Why a file is not analysed: test, too_large, minified, binary, unreadable; null if it is."""
    head = F.substring(content, 1, HEAD_BYTES)
    text = F.decode(head, "ISO-8859-1")
    lines = F.split(text, "\n")
    long_line = F.exists(lines, lambda x: F.char_length(x) > MAX_LINE) | ((size > WIDE_BYTES) & (F.char_length(text) > WIDE_LINE * F.size(lines)))
    out = F.when(content.isNull(), "unreadable").when(size > MAX_BYTES, "too_large").when(path.rlike("(?:" + "|".join(map(re.escape, MINIFIED)) + ")$"), "minified").when(F.instr(text, "\0") > 0, "binary").when(language.isin("javascript", "typescript", "tsx") & long_line, "minified")
    return out if include_tests else F.when(is_test(path, language), "test").otherwise(out)


def is_test(path: Column, language: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    by_name = F.when(language == "python", name.rlike("^(?:test_.*|.*_test|conftest)\\.py$")).when(language == "go", name.endswith("_test.go")).when(language.isin("javascript", "typescript", "tsx"), name.rlike("\\.(?:test|spec)\\.[cm]?[jt]sx?$")).when(language == "java", name.rlike("Tests?\\.java$")).when(language == "ruby", name.rlike("_(?:spec|test)\\.rb$"))
    return F.exists(folders, lambda x: x.isin(*TEST_FOLDERS) | x.endswith(".tests")) | F.coalesce(by_name, F.lit(False))


def pruned(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.isin(*PRUNED) | x.startswith(".git"))


def ignore_rules(lines: Sequence[str], folder: str = "") -> list[tuple[str, bool]]:
    """(regex over paths, whether it ignores) of a .gitignore's lines, in order."""
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        pattern = line[keeps:].removeprefix("\\")
        only_folder = pattern.endswith("/")
        pattern = pattern.strip("/") if "/" in pattern.rstrip("/") else "**/" + pattern.rstrip("/")
        regex, i = "", 0
        while i < len(pattern):
            if pattern.startswith("**/", i):
                regex, i = regex + "(?:.*/)?", i + 3
            elif pattern.startswith("**", i):
                regex, i = regex + ".*", i + 2
            else:
                regex += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i])
                i += 1
        base = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
        out.append((f"^{base}{regex}" + ("/.*$" if only_folder else "(?:/.*)?$"), not keeps))
    return out


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """The last rule that fits decides."""
    out = F.lit(False)
    for regex, ignores in rules:
        out = F.when(path.rlike(regex), F.lit(ignores)).otherwise(out)
    return out


@F.pandas_udf(StringType())
def content_hash(content: pd.Series) -> pd.Series:
    """blake2b of 16 bytes, in hex."""
    return content.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=16).hexdigest())


def walk(spark: SparkSession, root: str, rules: Sequence[tuple[str, bool]] = (), include_tests: bool = False) -> DataFrame:
    """Files of known languages under ``root``: path, language, size_bytes, mtime, content_hash, skip_reason, content."""
    df = read_tree(spark, root).where(~pruned(F.col("path")) & ~ignored(F.col("path"), rules))
    df = df.withColumn("language", language_of(F.col("path"), F.decode(F.substring("content", 1, 128), "ISO-8859-1"))).where(F.col("language").isNotNull())
    reason = skip_reason(F.col("path"), F.col("size_bytes"), F.col("content"), F.col("language"), include_tests)
    return df.select("path", "language", "size_bytes", "mtime", content_hash("content").alias("content_hash"), reason.alias("skip_reason"), F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("content"))


def _python_name(spec: str) -> str | None:
    """The name at the head of a requirement, as indexes compare it."""
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*)", spec)
    return m[1].lower().replace("_", "-") if m else None


def _pyproject(text: str) -> list[str | None]:
    t = tomllib.loads(text)
    project, poetry = t.get("project", {}), t.get("tool", {}).get("poetry", {})
    specs = [*project.get("dependencies", []), *(d for group in project.get("optional-dependencies", {}).values() for d in group), *poetry.get("dependencies", {})]
    return [n for n in map(_python_name, specs) if n != "python"]


def _json_names(*keys: str):
    def read(text: str) -> list[str]:
        t = json.loads(text)
        return [x for x in (t.get("name"),) if isinstance(x, str)] + [d for k in keys for d in t.get(k, {}) if d != "php" and not d.startswith("ext-")]

    return read


def _cargo(text: str) -> list[str]:
    t = tomllib.loads(text)
    tables = [t, t.get("workspace", {}), *t.get("target", {}).values()]
    return [d for x in tables for k in ("dependencies", "dev-dependencies", "build-dependencies") for d in x.get(k, {})]


def _maven(text: str) -> list[str]:
    """group:artifact of the dependencies, wherever they stand; plugins and the project itself are none."""
    bare = lambda e: e.tag.rpartition("}")[2]
    made = []
    for e in ElementTree.fromstring(text).iter():
        if bare(e) == "dependency":
            given = {bare(c): (c.text or "").strip() for c in e}
            if given.get("artifactId"):
                made.append(f"{given.get('groupId', '')}:{given['artifactId']}")
    return made


def _all(pattern: str, lower: bool = False):
    return lambda text: [m.lower() if lower else m for m in re.findall(pattern, text, re.M)]


#: File name (a regex), ecosystem, reader.
_READERS = (
    (r"requirements.*\.txt", "python", lambda text: [_python_name(line) for line in text.splitlines() if not line.lstrip().startswith(("#", "-"))]),
    (r"pyproject\.toml", "python", _pyproject),
    (r"package\.json", "javascript", _json_names("dependencies", "devDependencies", "peerDependencies")),
    (r"composer\.json", "php", _json_names("require", "require-dev")),
    (r"go\.mod", "go", _all(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\S+\s*(?:$|//(?!\s*indirect))")),
    (r"Cargo\.toml", "rust", _cargo),
    (r"Gemfile", "ruby", _all(r"^\s*gem\s+[\"']([^\"']+)")),
    (r"pom\.xml", "java", _maven),
    (r"build\.gradle.*", "java", _all(r"[\"']([\w.-]+:[\w.-]+)(?::[^\"']*)?[\"']")),
    (r".*\.csproj", "csharp", _all(r"<(?:PackageReference|Reference)\s+Include=\"([^\",]+)", True)),
    (r"packages\.config", "csharp", _all(r"<package\s+id=\"([^\"]+)", True)),
)


def dependencies(name: str, text: str) -> list[tuple[str, str]]:
    """(ecosystem, dependency) pairs of a manifest, by its file name; a text that cannot be read has none."""
    for pattern, ecosystem, read in _READERS:
        if re.fullmatch(pattern, name):
            try:
                return [(ecosystem, d) for d in read(text) if d]
            except (ValueError, AttributeError, TypeError, ElementTree.ParseError):
                return []
    return []


def manifests(tree: DataFrame) -> DataFrame:
    """(path, ecosystem, dependency) of the manifests in ``tree`` (path, content as text), five folders deep at most."""
    named = "(?:^|/)(?:requirements[^/]*\\.txt|pyproject\\.toml|package\\.json|go\\.mod|pom\\.xml|build\\.gradle(?:\\.kts)?|Gemfile|[^/]*\\.csproj|packages\\.config|composer\\.json|Cargo\\.toml)$"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, e, d) for p, c in zip(b["path"], b["content"]) for e, d in dependencies(p.rpartition("/")[2], c or "")]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "dependency"])

    found = tree.where(F.col("path").rlike(named) & (F.size(F.split("path", "/")) <= 5) & ~pruned(F.col("path")))
    return found.select("path", "content").mapInPandas(parse, "path string, ecosystem string, dependency string").distinct()


def config_entrypoints(tree: DataFrame) -> DataFrame:
    """(path, kind, handler) of root deployment files: serverless and SAM handlers, Procfile and Dockerfile commands."""
    handler = F.regexp_extract_all("content", F.lit("(?m)^\\s*[Hh]andler:\\s*[\"']?([\\w./-]+)"), F.lit(1))
    proc = F.regexp_extract_all("content", F.lit("(?m)^[A-Za-z0-9_-]+:\\s*(.+)$"), F.lit(1))
    run = F.regexp_extract_all("content", F.lit("(?m)^(?:CMD|ENTRYPOINT)\\s+(.+)$"), F.lit(1))
    found = F.when(F.col("path").rlike("^(?:serverless|template)\\.ya?ml$"), F.transform(handler, lambda x: F.struct(F.lit("lambda_handler").alias("kind"), x.alias("handler")))).when(F.col("path") == "Procfile", F.transform(proc, lambda x: F.struct(F.lit("main").alias("kind"), x.alias("handler")))).when(F.col("path") == "Dockerfile", F.transform(run, lambda x: F.struct(F.lit("main").alias("kind"), x.alias("handler"))))
    return tree.select("path", F.inline(found)).select("path", "kind", "handler")
