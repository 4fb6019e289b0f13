"""Geometry, vectors, discovery stages."""

import math
import random

import pytest

from weftgraph.engine import Engine
from weftgraph.operators import discovery
from weftgraph.plans.errors import QueryError

R = 6_371_008.8


def metres(a, b):
    lat = math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    lon = math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    h = lat + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * lon
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(5)
    pts = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    pts += [(rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(40)]
    pts += [(rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(178, 180)) for _ in range(40)]
    pts += [(90.0, 0.0), (90.0, 120.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0)]
    return pts


@pytest.mark.parametrize("limit", [1.0, 40_000.0, 250_000.0, 3_000_000.0])
def test_near_pairs_equal_brute_force(spark, places, limit):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(places)], "id long, lat double, lon double")
    got = {(r["from"], r["to"]) for r in discovery.near_pairs(df, limit, False).collect()}
    want = {(i, j) for i in range(len(places)) for j in range(i + 1, len(places)) if metres(places[i], places[j]) <= limit}
    edge = {(i, j) for i, j in got ^ want if abs(metres(places[i], places[j]) - limit) > 1e-3}
    assert not edge


def _score(a, b, metric):
    dot = sum(x * y for x, y in zip(a, b))
    if metric == "dot":
        return dot
    if metric == "l2":
        return -math.dist(a, b)
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return dot / n if n else 0.0


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.8), ("cosine", -0.2), ("l2", -0.9), ("dot", 1.5)])
def test_similar_pairs_equal_brute_force(spark, metric, threshold):
    rng = random.Random(11)
    vs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)] + [[0.0] * 4, [0.0] * 4, [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "id long, v array<double>")
    got = {(r["from"], r["to"]): r["score"] for r in discovery.similar_pairs(df, threshold, metric, 4, False).collect()}
    want = {(i, j): _score(vs[i], vs[j], metric) for i in range(len(vs)) for j in range(i + 1, len(vs)) if _score(vs[i], vs[j], metric) >= threshold}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


MIX = """
schema {
  type Item { title: String body?: String land?: String size?: Int v?: Vector<2> at?: Point of -> Shop }
  type Shop { title: String land: String }
}
mutation { Shop(title: "Harbour" && land: "SE") }
mutation { Item(title: "Anker" && body: "ein Anker" && land: "SE" && size: 1 && v: @vector[1, 0] && at: @point(50, 10)) }
mutation { Item(title: "Boat" && land: "NO" && size: 1 && v: @vector[0.9, 0.1] && at: @point(50, 10.001)) }
mutation { Item(title: "Café" && body: "50% off" && land: "SE" && size: 2 && v: @vector[0, 1]) }
mutation { Item(title: "Anker") { of -> link Shop(title: "Harbour") } }
"""


@pytest.fixture(scope="module")
def mix(spark):
    e = Engine.empty(spark)
    e.run(MIX)
    return e


def ids(stages, i=-1):
    return [n["id"] for n in stages["stages"][i]["nodes"]]


def test_text_stages(mix):
    q = lambda c, root="Item { title }": mix.run(f"query {{ {root} }} then {{ {c} }}")
    assert ids(q('findExact { "Anker" }')) == [2]
    assert ids(q('findLike { "CAFE" }')) == [4]
    assert ids(q('findLike { "0% o" in { body } }')) == [4]
    assert ids(q('findWithout { "Anker" }')) == [3, 4]
    assert ids(q('regex { "^[AB]" }')) == [2, 3]
    assert ids(q('startsExact { "A" } || endsExact { "t" }')) == [2, 3]
    assert ids(q('startsExact { "A" } && endsExact { "t" }')) == []
    with pytest.raises(QueryError, match="look-around"):
        q('regex { "(?=a)" }')
    with pytest.raises(QueryError, match="no type of this stage has a field"):
        q('findExact { "a" in { nothing } }')


def test_common_similar_near(mix):
    got = mix.run("query { Item { title of -> Shop { title } } } then { common { Item { land } Shop { land } } }")
    assert ids(got) == [1, 2, 4] and ids(got, 0) == [1, 2, 3, 4]
    assert [e["type"] for e in got["stages"][0]["edges"]] == ["of"]
    edges = got["stages"][1]["couldBeEdges"]
    assert edges == [{"from": 1, "to": t, "via": {"primitive": "common", "fields": ["Item.land", "Shop.land"], "value": "SE"}} for t in (2, 4)]
    got = mix.run("query { Item { title } } then { common { Item { land size } } }")
    assert ids(got) == []
    got = mix.run("query { Item { title } } then { similar { &v > 0.9 } }")["stages"][1]
    assert [(e["from"], e["to"]) for e in got["couldBeEdges"]] == [(2, 3)]
    got = mix.run("query { Item { title } } then { near { &at < 1 km } } then { findExact { \"Boat\" } }")["stages"]
    assert [n["id"] for n in got[1]["nodes"]] == [2, 3] and [n["id"] for n in got[2]["nodes"]] == [3]
    assert 50 < got[1]["couldBeEdges"][0]["via"]["distance"] < 100
    got = mix.run('query { Item { title } } display { skip } then { startsExact { "A" } }')
    assert [s["index"] for s in got["stages"]] == [1]


def test_vectors_and_places_in_queries(mix):
    got = mix.run("{ Item @near(v, @vector[1, 0], 2) { title @score } }")
    assert [r["title"] for r in got] == ["Anker", "Boat"] and got[0]["score"] == 1.0
    assert mix.run("{ Item(@similarity(v, @vector[0, 1]) >= 0.9) { title } }") == [{"title": "Café"}]
    assert mix.run("{ Item(@distance(at, @point(50, 10)) < 10) { title } }") == [{"title": "Anker"}]
    assert len(mix.run("{ Item(@within_box(at, @point(49, 9), @point(51, 11))) { title } }")) == 2
    assert mix.run("{ Item(@within_box(at, @point(49, 179), @point(51, -179))) { title } }") == []


@pytest.fixture
def written(monkeypatch):
    """(name, rows) of every table staged by discovery."""
    from weftgraph.plans import stages

    seen, real = [], discovery.staged

    def staged(df, name="stage"):
        out = real(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(discovery, "staged", staged)
    monkeypatch.setattr(stages, "staged", staged)
    return seen


def test_many_nodes_at_one_place_are_paired_without_writing_pairs(spark, written):
    from weftgraph.plans.parser import parse_schema
    from weftgraph.sources.graph import Graph

    n = 3000
    nodes = spark.range(n).selectExpr("id", "named_struct('lat', if(id = 7, 1.001D, 1D), 'lon', 2D) AS at").unionAll(spark.range(n, n + 1).selectExpr("id", "named_struct('lat', 50D, 'lon', 2D) AS at"))
    found = Engine(Graph(spark, parse_schema("schema { type A { at: Point } }"), {"A": nodes}, {})).pipeline("query { A { @id } } then { near { &at < 1 km } }")[-1]
    got = found.proposals.selectExpr("count(*)", "count(distinct `from` * 10000 + `to`)", "count_if(measure > 0)", "count_if(`from` >= `to`)").first()
    assert tuple(got) == (n * (n - 1) // 2, n * (n - 1) // 2, n - 1, 0)
    assert sorted(r.id for r in found.nodes.select("id").collect()) == list(range(n))
    assert max(rows for _, rows in written) <= n + 1


def test_vectors_are_sent_a_bounded_number_of_times(spark, written, monkeypatch):
    monkeypatch.setattr(discovery, "TILE", 8)
    rng = random.Random(3)
    vs = [[float(x) for x in (rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1))] for _ in range(1000)] + [[1.0, 0.0, 0.0, 0.0]] * 200
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "id long, v array<double>")
    got = [(r["from"], r["to"]) for r in discovery.similar_pairs(df, 0.8, "cosine", 4, False).collect()]
    want = {(i, j) for i in range(len(vs)) for j in range(i + 1, len(vs)) if _score(vs[i], vs[j], "cosine") >= 0.8}
    assert len(got) == len(want) and set(got) == want
    tiles = 32 + 4**3  # those of full cells, and a rest for each cell
    assert dict(written)["tiles"] <= tiles * (tiles + 1) / 2
