"""Globs, catalog patterns and text functions."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import patterns as P


def test_glob_escapes_before_it_translates():
    assert P.glob_to_like("a_b*c?") == "a\\_b%c_"


def test_braces_nest_and_are_stripped():
    assert sorted(P.expand_braces("x.{a, b{1,2}}")) == ["x.a", "x.b1", "x.b2"]


@pytest.mark.parametrize(("pattern", "text", "fits"), [("py:os.*", "py:os.path.join", True), ("py:os.*", "PY:os.x", False), ("a.[bc]", "a.b", True), ("a.[!b]", "a.b", False), ("a", "a\n", False)])
def test_catalog_regex(spark, pattern, text, fits):
    got = spark.createDataFrame([(text, P.catalog_regex(pattern))], "t string, r string").select(F.expr("t RLIKE r")).head()[0]
    assert got is fits


def test_text_functions(spark):
    row = spark.createDataFrame([('("k", 1)', "a  b\n c", "/users/:id/<int:page>")], "p string, t string, r string").select(
        P.constant_args(F.col("p")).alias("constant"), P.first_string_arg(F.col("p")).alias("key"), P.truncate(F.col("t"), 4).alias("cut"), P.route_params(F.col("r")).alias("params"), P.compose_route(F.lit("/a/"), F.lit("b"), F.lit("")).alias("route")
    ).head()
    assert (row["constant"], row["key"], row["cut"], row["params"], row["route"]) == (True, "k", "a b…", ["id", "page"], "/a/b")
    assert not re.search("[*]", row["cut"])
