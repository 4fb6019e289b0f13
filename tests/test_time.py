"""Valid time: as of, series, windows, recorded states, periods."""

import pytest

from weftgraph.engine import Engine
from weftgraph.plans.errors import QueryError

ROSTER = """
schema {
  type Term { year: Int starts: Date ends: Date period from starts to ends named by year }
  type Club { name: String points:<Int> squad -> <Person[]> calendar term -> Term }
  type Person { name: String born: Date died?: Date club: squad <- <Club[]> appears at born ends at died }
}
"""


@pytest.fixture(scope="module")
def roster(spark):
    e = Engine.empty(spark)
    e.run(
        ROSTER
        + """
mutation at 2024-01-01 { Club(name: "North" && points: 10) { name } }
mutation at 2024-01-15 { Club(name = "North") set points: 30 { points } }
mutation at 2024-01-08 { Club(name = "North") set points: 20 { points } }
mutation at 2023-10-10 { Club(name: "North") { squad -> link Person(name: "none") } }
"""
        .replace('mutation at 2023-10-10 { Club(name: "North") { squad -> link Person(name: "none") } }\n', "")
    )
    e.run('mutation { Person(name: "Pat" && born: "1990-01-01") { name } }')
    e.run('mutation { Person(name: "Old" && born: "1900-01-01" && died: "2024-01-10") { name } }')
    e.run('mutation at 2023-10-10 { Club(name: "North") { squad -> link Person(name: "Pat") } }')
    e.run('mutation at 2023-12-01 { Club(name: "North") { squad -> link Person(name: "Old") } }')
    e.run('mutation at 2024-02-01 { Club(name = "North") { squad -> unlink Person(name = "Pat") { name } } }')
    e.run('mutation { Term { year: 2023 starts: 2023-10-01 ends: 2024-01-12 } }')
    return e


def test_as_of_and_backfill(roster):
    assert roster.run('{ Club(name = "North") { points } }') == {"points": 30}
    assert roster.run("{ Club { points } } as of 2024-01-10") == [{"points": 20}]
    assert roster.run("{ Club { points } } as of 2023-12-31") == [{"points": None}]
    assert roster.run("{ Club { points } } as of 2024") == [{"points": 10}]


def test_series(roster):
    got = roster.run('{ Club(name = "North") { <points> } } from 2024-01-01 to 2024-01-20 by week')
    assert got == {"points": [{"time": "2024-01-01T00:00", "value": 10}, {"time": "2024-01-08T00:00", "value": 20}, {"time": "2024-01-15T00:00", "value": 30}]}
    got = roster.run('{ Club(name = "North") { <points> } } from 2024-01-01 to 2024-02-15 by month')
    assert [x["value"] for x in got["points"]] == [10, 30]


def test_recorded_states(roster):
    q = lambda c: [r["name"] for r in roster.run(f"{{ Club({c}) limit 9 {{ name }} }}")]
    assert q("ever points >= 30") == ["North"]
    assert q("always points >= 10") == ["North"]
    assert q("always points >= 20") == []
    assert q("ever points > 30") == []
    assert q("always points >= 20 during 2024-01-09 to 2024-01-20") == ["North"]
    assert q("always points >= 20 during 2024-01-07 to 2024-01-20") == []
    assert q('always has squad(name = "Pat") during 2023-11-01 to 2024-01-01') == ["North"]
    assert q('always has squad(name = "Pat") during 2023-11-01 to 2024-03-01') == []
    assert q("@firstTime(points >= 20) = 2024-01-08") == ["North"]
    got = roster.run('{ Club(name = "North") { @firstTime(points >= 20) last: @lastTime(points >= 20) } }')
    assert got == {"firstTime": "2024-01-08T00:00", "last": "2024-01-15T00:00"}
    got = roster.run("{ Person limit 9 { name @firstTime(has club(name = \"North\")) } }")
    assert got == [{"firstTime": "2023-10-10T00:00", "name": "Pat"}, {"firstTime": "2023-12-01T00:00", "name": "Old"}]


def test_rosters(roster):
    q = lambda t: roster.run(f'{{ Club(name = "North") {{ squad -> Person {{ name }} }} }} as of {t}')["squad"]
    assert q("2024-01-05") == [{"name": "Pat"}, {"name": "Old"}]
    assert q("2024-01-15") == [{"name": "Pat"}]
    assert q("2024-02-01") == []
    assert q("2023-10-09") == []
    got = roster.run('{ Club(name = "North") { squad -> Person during 2023-10-10 to 2024-04-18 { name } } }')
    assert got == {"squad": [{"name": "Pat"}, {"name": "Old"}]}
    got = roster.run('{ Club(name = "North") { squad -> Person changes from 2023-11-01 to 2024-03-08 { name } } }')
    assert got == {"squad": {"changed": [], "joined": [], "left": [{"name": "Pat"}]}}
    got = roster.run("{ Club limit 5 { name points } } during 2024-01-02 to 2024-01-20")
    assert got == [{"name": "North", "points": 10}]
    got = roster.run("{ Club limit 5 { points } } changes from 2024-01-02 to 2024-01-20")
    assert got["changed"] == [{"from": {"points": 10}, "id": 1, "to": {"points": 30}}]


def test_periods(roster):
    assert roster.run("{ Club limit 5 { points } } as of end of term 23") == [{"points": 20}]
    assert roster.run("{ Club limit 5 { points } } as of start of term 2023-24") == [{"points": None}]
    assert roster.run("{ Club(ever points >= 20 during term 23) limit 5 { name } }") == [{"name": "North"}]
    got = roster.run("{ Club limit 5 { <points> } } from term 23 to term 23 by term")
    assert got == [{"points": [{"time": "2023-10-01T00:00", "value": None}]}]
    with pytest.raises(QueryError, match="no term 2004"):
        roster.run("{ Club limit 5 { name } } during term 04")
    with pytest.raises(QueryError, match="no calendar era"):
        roster.run('{ Club limit 5 { name } } during era "x"')
