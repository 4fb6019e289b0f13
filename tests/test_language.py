"""Statements end to end: what is written is what is read back."""

import pytest

from weftgraph.engine import Engine
from weftgraph.plans.errors import QueryError

CLUB = """
schema {
  type Club {
    name: String
    town: String
    at: Point
    squad: PLAYS <- Person[]
    lead -> Person
  }
  type Person {
    name: String
    role: String
    pay: Int
    note?: String
    club: PLAYS -> Club { since: Int first?: Bool }
    teaches -> Person[]
  }
}
"""


@pytest.fixture(scope="module")
def club(spark):
    e = Engine.empty(spark)
    e.run(
        CLUB
        + """
mutation {
  Club(name: "Northern" && town: "Umea" && at: @point(63.8, 20.3)) {
    squad <- Person(name: "Ada" && role: "front" && pay: 900 && note: "captain in 2021") { &since: 2015 &first: true }
    squad <- Person(name: "Bo" && role: "back" && pay: 300) { &since: 2022 }
    squad <- Person(name: "Cleo" && role: "wing" && pay: 500 && note: "signed 2019") { &since: 2019 }
  }
}
mutation { Club(name: "Southern" && town: "Malmo" && at: @point(55.6, 13.0)) }
mutation { Person(name: "Dag" && role: "back" && pay: 100) }
mutation { Person(name: "Ada") { teaches -> link Person(name: "Bo") } }
mutation { Person(name: "Bo") { teaches -> link Person(name: "Cleo") } }
mutation { Person(name: "Cleo") { teaches -> link Person(name: "Dag") } }
"""
    )
    return e


def names(rows):
    return [r["name"] for r in rows]


def test_projection_nesting_and_order(club):
    assert club.run("query { Person { name role } }")[0] == {"name": "Ada", "role": "front"}
    got = club.run("query { Club { name lead -> Person { name } squad <- Person { name } } }")
    assert got == [
        {"lead": None, "name": "Northern", "squad": [{"name": "Ada"}, {"name": "Bo"}, {"name": "Cleo"}]},
        {"lead": None, "name": "Southern", "squad": []},
    ]
    assert list(got[0]) == ["lead", "name", "squad"]
    assert names(club.run("{ Person order by pay desc limit 2 { name } }")) == ["Ada", "Cleo"]
    assert names(club.run('{ Club order by @distance(at, @point(55, 13)) { name } }')) == ["Southern", "Northern"]
    assert names(club.run("{ Person order by note, pay { name } }")) == ["Ada", "Cleo", "Dag", "Bo"]
    got = club.run('{ Club(name: "Northern") { squad <- Person order by pay desc limit 1 { name } } }')
    assert got == {"squad": [{"name": "Ada"}]}


def test_say_one_get_one(club):
    assert club.run('{ Person(name: "Ada") { name club -> Club { name &since } } }') == {"name": "Ada", "club": {"name": "Northern", "since": 2015}}
    assert club.run('{ Person(name: "Zed") { name } }') is None
    assert club.run("{ Person(pay > 5000) { name } }") == []
    with pytest.raises(QueryError, match="more than one"):
        club.run('{ Person(role = "back") { name } }')
    assert club.run('{ Person(name: "Bo") { @id name } }') == {"id": 3, "name": "Bo"}


def test_conditions(club):
    q = lambda c: names(club.run(f"{{ Person({c}) {{ name }} }}"))
    assert q('role != "back"') == ["Ada", "Cleo"]
    assert q('note != "signed 2019"') == ["Ada", "Bo", "Dag"]
    assert q('note findExact "20"') == ["Ada", "Cleo"]
    assert q('name startsExact "C" || name endsExact "g"') == ["Cleo", "Dag"]
    assert q('name findLike "ADA" && pay > 1') == ["Ada"]
    assert q('role = "front" || role = "back" && pay < 200') == ["Ada", "Dag"]
    assert q('(role = "front" || role = "back") && pay < 400') == ["Bo", "Dag"]
    assert q('pay > "100"') == []
    assert q("note = null || pay = 900") == ["Ada", "Bo", "Dag"]
    assert q("@id > 3") == ["Cleo", "Dag"]


def test_walks_in_filters(club):
    q = lambda c: names(club.run(f"{{ Person({c}) {{ name }} }}"))
    assert q('has club(name = "Northern")') == ["Ada", "Bo", "Cleo"]
    assert q("!have club") == ["Dag"]
    assert q('has teaches in club(name = "Northern")') == ["Ada", "Bo"]
    assert q("has club && has teaches in same club") == ["Ada", "Bo"]
    assert q('has teaches exactly 2 hops(name = "Cleo")') == ["Ada"]
    assert q('has teaches within 3 hops(name = "Dag")') == ["Ada", "Bo", "Cleo"]
    assert q('has teaches min 3 hops(name = "Dag") || name = "Bo"') == ["Ada", "Bo"]
    assert names(club.run('{ Club(has squad(role = "wing")) { name } }')) == ["Northern"]
    assert names(club.run("{ Club(!have squad) { name } }")) == ["Southern"]
    got = club.run('{ Club { name squad <- Person(role = "wing") { name } } }')
    assert got == [{"name": "Northern", "squad": [{"name": "Cleo"}]}, {"name": "Southern", "squad": []}]


def test_hops_and_flat_rows(club):
    got = club.run('{ Person(name: "Ada") { teaches *1..3 -> Person { name @hops } } }')
    assert got == {"teaches": [{"hops": 1, "name": "Bo"}, {"hops": 2, "name": "Cleo"}, {"hops": 3, "name": "Dag"}]}
    assert club.run('{ Person(name: "Ada") { teaches max 2 hops -> Person { name } } }') == {"teaches": [{"name": "Bo"}, {"name": "Cleo"}]}
    rows = club.flat("{ Club { name squad <- Person { name &since } } }").collect()
    assert sorted((r[0], r[1], r[2]) for r in rows if r[1]) == [("Northern", "Ada", 2015), ("Northern", "Bo", 2022), ("Northern", "Cleo", 2019)]
    assert [r[0] for r in rows if not r[1]] == ["Southern"]


def test_errors_say_where_and_how(club):
    with pytest.raises(QueryError) as e:
        club.run("query {\n  Person { name rle }\n}")
    assert "no field rle" in str(e.value) and "did you mean `role`" in str(e.value) and e.value.line == 2
    for text, part in [
        ('{ Person(club = "x") { name } }', "is a relationship"),
        ("{ Person { club <- Club { name } } }", "points the other way"),
        ("{ Nobody { name } }", "no type Nobody"),
        ('{ Person(!has club) { name } }', "before `have`"),
        ("{ Person(has club within 2 hops) { name } }", "between one type and itself"),
        ("{ Person(has teaches || has club in same teaches) { name } }", "same"),
        ("{ Person { name @score } }", "@near"),
        ("mutation { Person(name: \"E\" && role: \"x\") }", "requires pay"),
        ("mutation { delete Person }", "needs a condition"),
    ]:
        with pytest.raises(QueryError, match=part):
            club.run(text)


def test_writes_are_whole_or_nothing(spark):
    e = Engine.empty(spark)
    e.run("schema { type A { name: String n?: Int to -> A up: one -> A } } unique { A { name } }")
    e.run('mutation { A(name: "a" && n: 1) }')
    e.run('mutation { A(name: "b") }')
    with pytest.raises(QueryError, match="already used"):
        e.run('mutation { A(name: "c") { to -> A(name: "a") } }')
    assert e.counts() == {"nodes": 2, "relationships": 0}
    e.run('mutation { A(name: "a") set n: 5 }')
    assert e.run('{ A(name: "a") { n } }') == {"n": 5}
    e.run('mutation { A(name: "a") { to -> link A(name: "b") } }')
    with pytest.raises(QueryError, match="single-valued"):
        e.run('mutation { A(name: "a") { to -> link A(name: "a") } }')
    with pytest.raises(QueryError, match="no A matched"):
        e.run('mutation { A(name: "q") set n: 5 }')
    with pytest.raises(QueryError, match="1 relationship"):
        e.run('mutation { delete A(name = "b") }')
    assert e.run('mutation { delete A(name = "b") { @detach @id name } }') == {"deleted": 1, "rows": [{"id": 2, "name": "b"}]}
    assert e.counts() == {"nodes": 1, "relationships": 0}
    assert e.run('mutation { A(name: "d") { @id name } }') == {"id": 3, "name": "d"}
    with pytest.raises(QueryError):
        e.transaction(['mutation { A(name: "x") }', 'mutation { A(name: "a") }'])
    assert names(e.run("{ A { name } }")) == ["a", "d"]


def test_loads(spark):
    e = Engine.empty(spark)
    sources = {
        "places.csv": "code,label,lat,lon,land\nAAA,First,10,20,X1\nBBB,\" Two, too \",-3.5,7.25,X1\nCCC,,0,0,X2\n",
        "lands.json": '[{"iso": "X1", "big": true}, {"iso": "X2", "big": false}]',
        "roads.csv": "a,b,km\nAAA,BBB,1.5\nBBB,CCC,2\n",
    }
    e.run(
        """
schema {
  type Land { iso: String big: Bool }
  type Place { code: String label?: String at: Point from (lat, lon) land -> Land road -> Place[] { km: Float<km> } }
}
unique { Land { iso } Place { code } }
mutation json ["lands.json"] { Land(iso: $iso && big: $big) { iso } }
mutation csv ["places.csv"] { Place(code: $code && label: $label) { code } }
mutation csv ["places.csv"] { Place(code: $code) { land -> link Land(iso: $land) } }
mutation csv ["roads.csv"] { Place(code: $a) { road -> link Place(code: $b) { &km: $km } } }
""",
        sources,
    )
    got = e.run("{ Place { code label at land -> Land { iso big } road -> Place { code &km } } }")
    assert got[0] == {"at": {"lat": 10.0, "lon": 20.0}, "code": "AAA", "label": "First", "land": {"big": True, "iso": "X1"}, "road": [{"code": "BBB", "km": 1.5}]}
    assert got[1]["label"] == "Two, too" and got[2]["label"] is None and got[1]["road"][0]["km"] == 2.0
    with pytest.raises(QueryError, match="no Land matched"):
        e.run('mutation csv ["bad.csv"] { Place(code: $c) { land -> link Land(iso: $l) } }', {"bad.csv": "c,l\nCCC,ZZ\n"})
    with pytest.raises(QueryError, match="already used"):
        e.run('mutation csv ["places.csv"] { Place(code: $code) { code } }', sources)
    assert e.counts()["nodes"] == 5
    got = e.run('{ Place(code: "AAA") { road *path by &km -> Place(code: "CCC") { code &km @hops } } }')["road"]
    assert got["cost"] == 3.5 and got["hops"] == 2
    assert got["nodes"] == [{"code": "AAA", "hops": 0, "km": None}, {"code": "BBB", "hops": 1, "km": 1.5}, {"code": "CCC", "hops": 2, "km": 2.0}]
    assert [(x["from"], x["to"], x["props"]) for x in got["edges"]] == [(3, 4, {"km": 1.5}), (4, 5, {"km": 2.0})]
