"""Ties over two kinds of relationship against plain breadth-first search; edits by id."""

import random

import pytest

from weftgraph.engine import Engine
from weftgraph.operators.proximity import connections, proximity
from weftgraph.plans.errors import QueryError
from weftgraph.streaming import changes


def _random(seed):
    rng = random.Random(seed)
    named = {(s, rng.randrange(30)) for s in range(4) for _ in range(2)}
    links = {(rng.randrange(30), rng.randrange(30)) for _ in range(35)}
    return named, links


def _levels(start, named, neighbours, most):
    """Least hops and the predecessor of least id of each node."""
    level = sorted({n for s, n in named if s == start})
    seen, depth = {n: (1, None) for n in level}, 1
    while level and depth < most:
        depth, following = depth + 1, {}
        for n in level:
            for m in neighbours(n):
                if m not in seen:
                    following[m] = min(following.get(m, n), n)
        seen |= {m: (depth, n) for m, n in following.items()}
        level = sorted(following)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_proximity_follows_links_both_ways(spark, seed):
    named, links = _random(seed)
    both = links | {(b, a) for a, b in links}
    got = proximity(spark.createDataFrame(sorted(named) * 2, "start long, node long"), spark.createDataFrame(sorted(links), "src long, dst long"), 3)
    want = {(s, n, h) for s in range(4) for n, (h, _) in _levels(s, named, lambda n: [b for a, b in both if a == n], 3).items()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("most", [None, 2])
def test_connections(spark, most):
    named, links = _random(5)
    asked = [(s, n, f"Site{n}.example/a") for s in range(5) for n in range(30)]
    official = [(0, "site1*"), (0, "site12"), (1, ""), (2, "*"), (3, "other")]
    got = connections(
        spark.createDataFrame(asked * 2, "start long, node long, path string"),
        spark.createDataFrame(sorted(named), "start long, node long"),
        spark.createDataFrame(sorted(links), "src long, dst long"),
        spark.createDataFrame(official, "start long, prefix string"),
        most,
    )
    want = set()
    for s, n, path in asked:
        seen = _levels(s, named, lambda n: [b for a, b in links if a == n], 99 if most is None else most + 1)
        fitting = [p.rstrip("*") for o, p in official if o == s and p.rstrip("*") and path.lower().startswith(p.rstrip("*"))]
        if (s, n) in named:
            want.add((s, n, "named", None, (n,)))
        elif fitting:
            want.add((s, n, "official", max(fitting, key=len), (n,)))
        elif n in seen:
            route = [n]
            while seen[route[0]][1] is not None:
                route.insert(0, seen[route[0]][1])
            want.add((s, n, "linked", None, tuple(route)))
        else:
            want.add((s, n, "none", None, None))
    rows = [(r.start, r.node, r.way, r.prefix, tuple(r.nodes) if r.nodes else None) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert {w for _, _, w, _, _ in rows} == {"named", "official", "linked", "none"}


def test_nothing_asked_or_named(spark):
    none, links = spark.createDataFrame([], "start long, node long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    assert proximity(none, links).count() == 0 and connections(none, none, links).count() == 0
    asked = spark.createDataFrame([(1, 2)], "start long, node long")
    assert [tuple(r) for r in connections(asked, none, links).collect()] == [(1, 2, "none", None, None)]


def test_edits_by_id(spark):
    e = Engine.empty(spark, "schema { type A { k: Int one -> B likes -> A[] by: owns <- B[] needs -> A[] { w: Int } } type B { k: Int } }")
    e.run("mutation { A(k: 1) { @id } A(k: 2) { @id } B(k: 3) { @id } }")
    ids = {r.k: r.id for r in e.graph.node("A").select("k", "id").unionAll(e.graph.node("B").select("k", "id")).collect()}
    e.connect("A", "likes", [(ids[1], ids[2]), (ids[2], ids[1])])
    e.connect("A", "one", [(ids[1], ids[3])])
    e.connect("A", "by", [(ids[2], ids[3])])
    assert e.run("{ A(k = 1) { k likes -> A { k } one -> B { k } } }") == {"k": 1, "likes": [{"k": 2}], "one": {"k": 3}}
    assert e.run("{ A(k = 2) { by <- B { k } } }") == {"by": [{"k": 3}]}
    before = e.counts()
    for source, field, pair, why in [
        ("A", "one", (ids[1], ids[3]), "single-valued"),
        ("A", "likes", (ids[1], ids[3]), "no node of A"),
        ("A", "likes", (ids[1], 999), "no node of A"),
        ("A", "hates", (ids[1], ids[2]), "no relationship hates"),
        ("A", "needs", (ids[1], ids[2]), "requires &w"),
    ]:
        with pytest.raises(QueryError, match=why):
            e.connect(source, field, [pair])
    assert e.counts() == before == {"nodes": 3, "relationships": 4}
    first = e.graph.rel("likes").agg({"rel_id": "min"}).first()[0]
    e.delete_relationships("likes", [first, 12345])
    assert e.counts() == {"nodes": 3, "relationships": 3}
    e.delete_nodes([ids[3], 999])
    assert e.counts() == {"nodes": 2, "relationships": 1}
    feed = [(r.version, r.node_id, r.op) for r in changes.since(changes.of_engine(e), 4).orderBy("version", "node_id").collect()]
    assert feed == [(5, ids[1], "unlink"), (5, ids[2], "unlink"), (6, ids[3], "delete")]


@pytest.mark.parametrize("most", [2, 3])
def test_proximity_sends_one_row_for_each_named_node(spark, monkeypatch, most):
    """No pair of start and node is shuffled again for each level; hubs walk by levels, with the same answer."""
    from weftgraph.operators import proximity as P

    named, links = _random(3)
    frames = spark.createDataFrame(sorted(named) + [(0, 500)], "start long, node long"), spark.createDataFrame(sorted(links), "src long, dst long")
    monkeypatch.setattr(P, "DEGREE_MOST", 0, raising=False)
    want = sorted(map(tuple, P.proximity(*frames, most).collect()))
    monkeypatch.setattr(P, "DEGREE_MOST", 64, raising=False)
    monkeypatch.setattr(P, "reach", None)
    assert sorted(map(tuple, P.proximity(*frames, most).collect())) == want


def test_connections_of_two_links_write_no_levels(spark, monkeypatch):
    from weftgraph.operators import proximity as P

    named, links = _random(6)
    asked = [(s, n) for s in range(5) for n in range(30)]
    frames = spark.createDataFrame(asked, "start long, node long"), spark.createDataFrame(sorted(named), "start long, node long"), spark.createDataFrame(sorted(links), "src long, dst long")
    monkeypatch.setattr(P, "DEGREE_MOST", 0, raising=False)
    want = sorted(map(str, P.connections(*frames, most=2).collect()))
    monkeypatch.setattr(P, "DEGREE_MOST", 64, raising=False)
    seen, real = [], P.staged
    monkeypatch.setattr(P, "staged", lambda df, name="stage": seen.append(name) or real(df, name))
    assert sorted(map(str, P.connections(*frames, most=2).collect())) == want
    assert set(seen) <= {"asked", "links"}
