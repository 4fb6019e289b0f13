"""Bulk lines, storage, schema differences, deliveries, change data, SQL."""

import json

import pytest

from weftgraph.engine import Engine
from weftgraph.plans.errors import QueryError
from weftgraph.plans.parser import parse_schema
from weftgraph.sources import graph as graphs
from weftgraph.sources import json_lines
from weftgraph.streaming import changes
from weftgraph.streaming.deliveries import Deliveries
from weftgraph.writes import diff, validate

SCHEMA = "schema { type Item { code: String name?: String at?: Point tags?: String[] likes -> Item[] { rank?: String } } } unique { Item { code } }"


def _lines(tmp_path, lines):
    path = tmp_path / "graph.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_bulk_lines(spark, tmp_path):
    lines = [
        {"type": "node", "id": 42, "labels": ["Item"], "props": {"code": "a", "name": "A", "at": {"lat": 1, "lon": 2}, "tags": ["x", "y"]}},
        "",
        {"type": "node", "labels": ["Item"], "props": {"code": "b"}},
        {"type": "rel", "kind": "likes", "from": 42, "to": 43, "props": {"rank": "high"}},
    ]
    g = json_lines.read(spark, _lines(tmp_path, lines), parse_schema(SCHEMA))
    e = Engine(g)
    assert e.counts() == {"nodes": 2, "relationships": 1}
    got = e.run('{ Item(code: "a") { @id at tags likes -> Item { @id code &rank } } }')
    assert got == {"at": {"lat": 1.0, "lon": 2.0}, "id": 42, "likes": [{"code": "b", "id": 43, "rank": "high"}], "tags": ["x", "y"]}
    for bad, why in [
        ({"type": "node", "id": 1, "labels": ["Item"], "props": {}, "from": 2}, "unknown field from"),
        ({"type": "node", "id": 1, "labels": []}, "a node has labels"),
        ({"type": "rel", "kind": "likes", "from": 1}, "kind, from and to"),
        ({"type": "rel", "kind": "likes", "from": 42, "to": 99}, "no earlier line defines to 99"),
        ({"type": "node", "id": 42, "labels": ["Item"]}, "used twice"),
        ("{broken", "not a JSON object"),
    ]:
        with pytest.raises(QueryError, match=why):
            json_lines.read(spark, _lines(tmp_path, [*lines, bad]), parse_schema(SCHEMA))
    with pytest.raises(QueryError, match="already used"):
        json_lines.read(spark, _lines(tmp_path, [*lines, {"type": "node", "labels": ["Item"], "props": {"code": "a"}}]), parse_schema(SCHEMA))


def test_lines_without_ids(spark):
    """Ids given and missing in any order against a plain running maximum."""
    import random

    rng = random.Random(3)
    given, top = [], 0
    for _ in range(400):
        given.append(rng.choice([None, None, top + rng.randrange(400, 900), rng.randrange(1, 5) * -1]))
        top = max(top, given[-1] or 0)
    want, most, run = [], 0, 0
    for x in given:
        if x is not None and x > most:
            most, run = x, 0
        run += x is None
        want.append(most + run if x is None else x)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "line long, id long")
    assert [r.id for r in json_lines._ids(df, "id").orderBy("line").collect()] == want


@pytest.fixture
def engine(spark):
    e = Engine.empty(spark)
    e.run("schema { type A { name: String n?: Int tag?: String to -> A[] { w?: Int } } type B { name: String } } unique { A { name } }")
    e.run('mutation { A(name: "x" && n: 1 && tag: "7") { to -> A(name: "y" && tag: "q") { &w: 3 } } }')
    return e


def test_saved_graphs_come_back(engine, tmp_path):
    path = str(tmp_path / "saved")
    assert graphs.save(engine.graph, path) == 1
    engine.run('mutation { A(name: "z") }')
    assert graphs.save(engine.graph, path) == 2
    spark = engine.spark
    assert Engine(graphs.load(spark, path)).counts()["nodes"] == 3
    old = Engine(graphs.load(spark, path, 1))
    assert old.counts()["nodes"] == 2 and old.run('{ A(name: "x") { to -> A { name &w } } }') == {"to": [{"name": "y", "w": 3}]}
    assert old.graph.schema.written() == engine.graph.schema.written()
    with pytest.raises(FileNotFoundError):
        graphs.load(spark, str(tmp_path / "none"))


def test_schema_differences(engine):
    new = parse_schema("schema { type A { name: String n: Int tag?: Int extra?: Bool to -> A { w: Int } } type C { name: String } }")
    report = diff.schema_diff(engine.graph, new)
    found = {(c.change, c.subject): (c.affected, c.severity) for c in report.changes}
    assert found[("type renamed", "B to C")] == (0, "Warn")
    assert found[("optional to required", "A.n")] == (1, "Blocks")
    assert found[("field type changed", "A.tag")] == (1, "Blocks")
    assert found[("field added", "A.extra")] == (2, "Safe")
    assert found[("relationship changed", "A.to")] == (0, "Warn")
    assert found[("optional to required", "A.to&w")] == (0, "Warn")
    assert not report.ok
    with pytest.raises(QueryError, match="does not fit"):
        engine.reset_schema(new.written())
    assert diff.schema_diff(engine.graph, engine.graph.schema).changes == ()


def test_reports_exports_and_sql(engine):
    rows = {(r.check, r.subject): r.violations for r in validate.report(engine.graph).collect()}
    assert rows[("unique", "A.name")] == 0 and rows[("required", "A")] == 0
    got = engine.export()
    assert [n["id"] for n in got["nodes"]] == [1, 2] and got["rels"] == [{"id": 1, "type": "to", "from": 1, "to": 2, "props": {"w": 3}}]
    assert [tuple(r) for r in engine.sql("SELECT name FROM A WHERE n = ?", [1]).collect()] == [("x",)]


def test_deliveries_apply_once(engine):
    d = Deliveries(engine)
    assert d.deliver("s", "1", ['mutation { A(name: "d") { name } }']) == [{"name": "d"}]
    assert d.deliver("s", "1", ['mutation { A(name: "d") { name } }']) == [{"name": "d"}]
    assert engine.counts()["nodes"] == 3
    with pytest.raises(QueryError, match="another payload"):
        d.deliver("s", "1", ['mutation { A(name: "e") }'])
    with pytest.raises(QueryError):
        d.batch([("s", "2", ['mutation { A(name: "f") }']), ("s", "3", ['mutation { A(name: "f") }'])])
    assert engine.counts()["nodes"] == 4 and d.receipts.count() == 2
    d.forget_before("s", "2")
    assert [r.txid for r in d.receipts.collect()] == ["2"]


def test_delivery_streams(engine, tmp_path):
    d, spark = Deliveries(engine), engine.spark
    rows = [("s", "1", 'mutation { A(name: "s1") }', 1), ("s", "1", 'mutation { A(name: "s2") }', 2), ("s", "2", 'mutation { A(name: "s3") }', 3)]
    frame = spark.createDataFrame(rows, "source_id string, txid string, statement string, seq long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    d.stream(source, str(tmp_path / "point")).awaitTermination(120)
    assert engine.counts()["nodes"] == 5 and d.receipts.count() == 2
    d.stream(source, str(tmp_path / "again")).awaitTermination(120)
    assert engine.counts()["nodes"] == 5


def test_changes_and_mirrors(engine):
    spark = engine.spark
    engine.run('mutation { A(name: "x") set n: 9 }')
    log = changes.of_engine(engine)
    last = changes.since(log, 1).collect()
    assert [(r.op, json.loads(r.fields["n"])) for r in last] == [("set", [9])]
    rows = [(1, 7, "set", {"a": "1", "b": "2"}, [5, 6], []), (2, 7, "set", {"a": "3"}, [], [5]), (3, 8, "set", {}, [], [4])]
    got = {r.node_id: r for r in changes.coalesced(spark.createDataFrame(rows, changes.CHANGE)).collect()}
    assert got[7].fields == {"a": "3", "b": "2"} and got[7].added == [6] and got[7].removed == [] and got[8].removed == [4]
    state = spark.createDataFrame([("k", 1, "a"), ("m", 4, "z")], "key string, version long, payload string")
    batch = spark.createDataFrame([("k", 2, "b"), ("k", 3, "c"), ("k", 5, "e"), ("m", 3, "old"), ("n", 1, "new")], "key string, version long, payload string")
    new, gaps = changes.mirror(state, batch)
    assert sorted(tuple(r) for r in new.collect()) == [("k", 3, "c"), ("m", 4, "z"), ("n", 1, "new")]
    assert [(r.key, r.missing) for r in gaps.collect()] == [("k", 4)]
