"""Filter strings, patterns, literals, pipeline, search and the dialect's own rules on small tables."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodemill import errors
from lodemill.functions.literals import infer_literal
from lodemill.functions.patterns import regexp_pattern
from lodemill.operators import pipeline as p
from lodemill.operators import search
from lodemill.operators.filters import filters_to_column
from lodemill.plans.dialect import run_select
from lodemill.plans.lexer import tokens
from lodemill.plans.parser import parse_select


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "alpha", 10, True, 1.5), (2, "beta", 20, False, 2.5), (3, "gamma", 30, True, 3.5), (4, "delta", 40, False, 4.5), (5, "epsilon", 50, True, 5.0)]
    return spark.createDataFrame(rows, "id long, name string, score long, active boolean, rating double").coalesce(1)


@pytest.mark.parametrize(
    ("filters", "n"),
    [
        (["active=true", "score__gt=20"], 2), (["name=alpha", "OR:score__gt=45"], 2), (["score__in=10,30,50"], 3), (["score__in=30"], 1), (["name__like=%a%"], 4),
        (["name__like=_eta"], 1), (["name__endswith=ta"], 2), (["rating__gte=4.0"], 2), (["active=1"], 3), (["name__gt=zeta"], 0), (["score__between=20,40"], 3),
        (["nothing__isnull"], 5), (["nothing=1"], 0), ([], 5), (["name__ilike=ALPH_"], 1), (["name__regexp=^.*[lt]a$"], 2), (["score=hello"], 0),
    ],
)
def test_filters(items, filters, n):
    assert items.filter(filters_to_column(items.schema, filters)).count() == n


def test_filters_reach_the_scan(items, tmp_path):
    items.write.parquet(f"{tmp_path}/t")
    df = items.sparkSession.read.parquet(f"{tmp_path}/t")
    plan = df.filter(filters_to_column(df.schema, ["score__gt=20", "name__startswith=g"])).select("id")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThan\(score,20\).*StringStartsWith\(name,g\)", plan)
    assert "rating" not in plan.split("ReadSchema")[1]


def test_bad_filters(items):
    for bad in ("score", "=3", "score__between=3"):
        with pytest.raises(errors.SyntaxProblem):
            filters_to_column(items.schema, [bad])


@pytest.mark.parametrize(
    ("text", "value"),
    [("", None), ("nil", None), ("NULL", None), ("yes", True), ("0", False), ("42", 42), ("-7", -7), ("3.14", 3.14), ("1e10", 1e10), ("42abc", "42abc"), ("hello", "hello")],
)
def test_literals(text, value):
    assert infer_literal(text) == value and type(infer_literal(text)) is type(value)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_literals_never_fail(text):
    assert infer_literal(text) is None or isinstance(infer_literal(text), (bool, int, float, str))


def _python(pattern):
    return pattern.replace("\\z", "\\Z")


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        ("a|b", "a", False), ("a|b", "xa|bx", True), ("(a)", "(a)", True), ("\\d", "d", True), ("\\d", "5", False), ("a.c", "a\nc", True), ("^a", "ba", False), ("a$", "a\n", False),
        ("b^", "b^", True), ("*a", "*a", True), ("a{2}", "aa", False), ("a{2}", "a{2}", True), ("[]x]", "]", True), ("[^a-c]", "b", False), ("[a&&b]", "&", True), ("[[]", "[", True),
    ],
)
def test_regexp_patterns(pattern, text, found):
    assert bool(re.search(_python(regexp_pattern(pattern)), text)) is found


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.*+?[]^$|(){}\\-&", max_size=10))
def test_regexp_patterns_always_compile(pattern):
    re.compile(_python(regexp_pattern(pattern)))


def test_pipeline(spark):
    sales = spark.createDataFrame([("east", "alice", 100.0), ("east", "bob", 150.0), ("west", "carol", 200.0), ("west", "dave", None)], "region string, rep string, amount double")
    out = p.aggregate(sales, [p.match("amount__gt=50"), p.group(["region"], total=("SUM", "amount"), n=("COUNT", None)), p.sort(("total", False)), p.limit(1)])
    assert [tuple(r) for r in out.collect()] == [("east", 250.0, 2)]
    assert p.aggregate(sales, [p.limit(0)]).count() == 0
    assert [tuple(r) for r in p.aggregate(sales, [p.match("amount__lt=0"), p.group([], s=("SUM", "amount"), a=("AVG", "amount"))]).collect()] == [(0.0, 0.0)]
    tags = spark.createDataFrame([("a", ["x", "y"]), ("b", None), ("c", [])], "name string, tags array<string>")
    assert [tuple(r) for r in p.aggregate(tags, [p.unwind("tags")]).collect()] == [("a", "x"), ("a", "y")]
    assert p.aggregate(tags, [p.unwind("name")]).count() == 0
    orders = spark.createDataFrame([(2, 1, 5.0), (1, 1, 7.0), (3, None, 1.0)], "id long, customer long, amount double")
    people = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    found = {r.name: [x.id for x in r.orders] for r in p.aggregate(people, [p.lookup(orders, "id", "customer", "orders")]).collect()}
    assert found == {"a": [1, 2], "b": [], "c": []}


def test_search(spark):
    rows = [(1, "Dog", "the dog barks"), (2, "Cat", "a cat"), (3, "dog dog dog", None)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    assert [(r.id, r._score) for r in search.text_search(df, "DOG").collect()] == [(3, 3), (1, 2)]
    assert [r.id for r in search.text_search(df, "dog barks", match_all=True).collect()] == [1]
    assert search.text_search(df, "dog", limit=1).count() == 1
    with pytest.raises(errors.InvalidArgument):
        search.text_search(df, "...")
    cities = spark.createDataFrame([("NYC", 40.7128, -74.006), ("Boston", 42.3601, -71.0589), ("LA", 34.0522, -118.2437), ("London", 51.5074, -0.1278), ("?", None, 1.0)], "name string, lat double, lon double")
    near = search.geo_near(cities, "lat", "lon", (40.7128, -74.006), 500).collect()
    assert [r.name for r in near] == ["NYC", "Boston"] and 290 < near[1]._distance_km < 320
    assert search.geo_within_box(cities, "lat", "lon", (24, -125), (50, -66)).count() == 3
    with pytest.raises(errors.InvalidArgument):
        search.geo_near(cities, "lat", "lon", (91, 0))


def test_dialect_rules(spark):
    t = spark.createDataFrame([(1, 10.0, 3, "a"), (2, 5.0, 0, "b"), (3, None, 5, "c")], "id long, price double, qty long, name string")
    run = lambda sql, *params: [tuple(r) for r in run_select(spark, sql, {"t": t}, params).collect()]
    assert run("SELECT name FROM t WHERE price / qty > 3") == [("a",)]
    assert run("SELECT SUM(price) AS s, AVG(qty) AS a, COUNT(price) AS n FROM t WHERE id > 5") == [(0.0, 0.0, 0)]
    assert run("SELECT name, SUM(qty) OVER (ORDER BY id) AS s FROM t ORDER BY name LIMIT 1") == [("a", 8.0)]
    assert run("SELECT STRING_AGG(name, '-') AS s FROM t") == [("a-b-c",)]
    assert run("SELECT * FROM t WHERE name = ? OR qty = $2", "b", 5) == [(5.0, 0, "b"), (None, 5, "c")]
    assert run("SELECT COUNT(*) FROM t LIMIT 0") == [(3,)]
    assert run_select(spark, "SELECT COUNT(*), MAX(qty) FROM t", {"t": t}).columns == ["COUNT(*)", "MAX(qty)"]
    for bad in (
        "SELECT * FROM t GROUP BY name", "SELECT price FROM t GROUP BY name", "SELECT name FROM t WHERE name = NULL", "SELECT RANK() FROM t", "SELECT name FROM t UNION SELECT name FROM t EXCEPT SELECT name FROM t",
        "SELECT name FROM t CROSS JOIN t u ON t.id = u.id", "SELECT t.name FROM t JOIN t ON t.id = t.id", "SELECT SUM(DISTINCT qty) FROM t", "SELECT name FROM t LIMIT x", "SELECT name, qty FROM t UNION SELECT name FROM t",
    ):
        with pytest.raises(errors.SyntaxProblem):
            run(bad)
    with pytest.raises(errors.NotFound):
        run("SELECT nope FROM t")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_any_text_parses_or_is_refused(text):
    try:
        tokens(text)
        parse_select(text)
    except errors.SyntaxProblem:
        pass
