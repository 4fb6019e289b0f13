"""Routes and bands against exhaustive search on random graphs."""

import heapq
import random

import pytest

from weftgraph.engine import Engine
from weftgraph.operators import paths, walks
from weftgraph.plans.errors import QueryError
from weftgraph.plans.parser import parse_schema
from weftgraph.sources.graph import Graph


def _graph(seed, n, m, zero=False):
    rng = random.Random(seed)
    return [(k, rng.randrange(n), rng.randrange(n), rng.choice([0, 1, 2, 3] if zero else [1, 2, 3])) for k in range(m)]


def _dijkstra(edges, n, start):
    best, heap = {start: 0}, [(0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for _, a, b, w in edges:
            if a == u and d + w < best.get(b, 1 << 30):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cheapest_and_fewest(spark, seed):
    n, edges = 9, _graph(seed, 9, 18, zero=True)
    adj = spark.createDataFrame([(a, b, k, float(w)) for k, a, b, w in edges], "src long, dst long, rel_id long, `&w` double")
    starts = spark.createDataFrame([(i,) for i in range(n)], "id long")
    goals = spark.createDataFrame([(7,), (8,)], "id long")
    for weight in ("w", None):
        found = {r.start: r for r in paths.routes(starts, adj, goals, weight).collect()}
        for s in range(n):
            best = _dijkstra([(k, a, b, w if weight else 1) for k, a, b, w in edges], n, s)
            want = min((best[g] for g in (7, 8) if g in best), default=None)
            assert (found[s].cost if s in found else None) == want
            if s in found:
                r, by = found[s], {k: (a, b, w) for k, a, b, w in edges}
                assert r.nodes[0] == s and r.nodes[-1] in (7, 8) and len(r.rels) == r.hops
                assert [by[k][:2] for k in r.rels] == list(zip(r.nodes, r.nodes[1:]))
                assert sum(by[k][2] if weight else 1 for k in r.rels) == want
                assert len(set(r.nodes)) == len(r.nodes)


@pytest.mark.parametrize("seed", [4, 5])
def test_bands(spark, seed):
    n, edges = 10, _graph(seed, 10, 16)
    adj = spark.createDataFrame([(a, b, k) for k, a, b, _ in edges], "src long, dst long, rel_id long")
    unit = [(k, a, b, 1) for k, a, b, _ in edges]
    dist = {s: {v: d for v, d in _dijkstra(unit, n, s).items() if v != s} for s in range(n)}
    starts = spark.createDataFrame([(i, i) for i in range(n)], "start long, node long")
    for low, high in ((1, 1), (1, 3), (2, 2), (2, 4)):
        for arrivals in (False, True):
            got = {(r.start, r.node): r.depth for r in walks.reach(starts, adj, low, high, arrivals).collect()}
            assert got == {(s, v): d for s in dist for v, d in dist[s].items() if low <= d <= high}
    ends = spark.createDataFrame([(2,), (5,)], "id long")
    for high in (1, 2, 4):
        got = {r.id for r in walks.within(ends, adj, high).collect()}
        assert got == {s for s in dist if any(v in dist[s] and dist[s][v] <= high for v in (2, 5))}


ROADS = """
schema { type Stop { name: String at?: Point road -> Stop[] { km?: Float<km> } } }
mutation { Stop(name: "A" && at: @point(0, 0)) }
mutation { Stop(name: "B" && at: @point(0, 0.01)) }
mutation { Stop(name: "C" && at: @point(0, 0.02)) }
mutation { Stop(name: "A") { road -> link Stop(name: "B") { &km: 1.2 } } }
mutation { Stop(name: "B") { road -> link Stop(name: "C") { &km: 1.3 } } }
mutation { Stop(name: "A") { road -> link Stop(name: "C") { &km: 4 } } }
"""


def test_path_statements(spark):
    e = Engine.empty(spark)
    e.run(ROADS)
    q = lambda p: e.run(f'{{ Stop(name: "A") {{ road *path{p} -> Stop(name: "C") {{ name }} }} }}')["road"]
    assert q("")["cost"] == 1 and [n["name"] for n in q("")["nodes"]] == ["A", "C"]
    assert q(" by &km")["cost"] == 2.5
    assert q(" by &km toward at")["cost"] == 2.5
    assert q("(@cost < 2.5) by &km") is None
    assert q("(@cost <= 2.5) by &km")["hops"] == 2
    got = e.run('{ Stop(name: "A") { road *path -> Stop(name: "A") { name } } }')["road"]
    assert got["cost"] == 0 and got["edges"] == []
    assert e.run('{ Stop(name: "C") { road *path -> Stop(name: "A") { name } } }') == {"road": None}
    e.run('mutation { Stop(name: "B") { road -> link Stop(name: "A") } }')
    with pytest.raises(Exception, match="has no km"):
        q(" by &km")
    with pytest.raises(QueryError, match="bounded by @cost"):
        q("(@hops < 3) by &km")


def test_work_is_counted_and_bounded(spark):
    """A line of four roads to the goal and a line of eight away from it."""
    schema = parse_schema("schema { type Stop { n: Int at?: Point road -> Stop[] { km?: Float<km> } } }")
    places = {i: (0.0, 0.01 * i) for i in range(1, 6)} | {10 + i: (0.0, 0.005 - 0.005 * i) for i in range(8)}
    roads = [(i, i + 1) for i in range(1, 5)] + [(1, 10)] + [(10 + i, 11 + i) for i in range(7)]
    nodes = spark.createDataFrame([(k, k, p) for k, p in places.items()], "id long, n long, at struct<lat double, lon double>")
    rels = spark.createDataFrame([(i, a, b, abs(places[a][1] - places[b][1]) * 112.0) for i, (a, b) in enumerate(roads)], "rel_id long, src long, dst long, km double")
    g = Graph(spark, schema, {"Stop": nodes}, {"road": rels})
    e = Engine(g, counting=True)
    path, hops = "{ Stop(n = 1) { road *path%s -> Stop(n = 5) { n } } }", "{ Stop(n = 1) { road *1..2 -> Stop { n } } }"
    costs, work = [], []
    for how in (" by &km", " by &km toward at"):
        costs.append(e.run(path % how)["road"]["cost"])
        work.append(e.work)
    assert costs[0] == pytest.approx(costs[1])
    assert work[1].nodes_expanded < work[0].nodes_expanded and work[1].relationships_read < work[0].relationships_read
    assert [x["n"] for x in e.run(hops)["road"]] == [2, 10, 3, 11]  # by hops, then id
    assert (e.work.nodes_expanded, e.work.relationships_read) == (1 + 2, 2 + 2)
    Engine(g, budget=4).run(hops)
    for text in (hops, path % "", "{ Stop(has road within 4 hops(n = 5)) { n } }"):
        with pytest.raises(QueryError, match="reads more than"):
            Engine(g, budget=3).run(text)


def test_routes_broadcast_no_tables(spark):
    adj = spark.createDataFrame([(i, i + 1, i) for i in range(6)], "src long, dst long, rel_id long")
    found = paths.routes(spark.createDataFrame([(0,)], "id long"), adj, spark.createDataFrame([(5,)], "id long"))
    assert found.first().hops == 5
    assert "Broadcast" not in found._jdf.queryExecution().toString()
