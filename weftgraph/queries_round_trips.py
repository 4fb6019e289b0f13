"""Registered queries of nested results, recorded time, loads and writes.

Each writes, loads or nests over the driver's tables and reads back what it
made; its SQL says the same to DuckDB.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import search, values, vectors
from .operators.proximity import connections, proximity
from .plans.parser import parse_schema
from .sources import files, json_lines
from .sources.graph import Graph, export_rels, load, save
from .sources.staging import shared_dir, staged
from .sources.tables import NUMBERS, shop
from .registry import HISTORY, QUERY_VECTOR, engine, flat, plain, query


def _json(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def _unique_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- projections ---------------------------------------------------------------------

flat("projected_ids", "{ Nation { @id key } }", f"SELECT {NUMBERS['Nation']} * 1099511627776 + n_nationkey AS id, CAST(n_nationkey AS BIGINT) AS key FROM nation")
flat("filter_unique_field", "{ Customer(key = 7) { key name } }", "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey = 7")


@query("SELECT n_name AS name, coalesce('[' || string_agg('{\"acctbal\":' || CAST(c_acctbal AS VARCHAR) || ',\"key\":' || c_custkey || '}', ',' ORDER BY c_acctbal DESC, c_custkey) || ']', '[]') AS customers FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal BETWEEN 100 AND 900000) ON c_nationkey = n_nationkey AND r <= 2 GROUP BY 1")
def nested_results(spark, sf_dir):
    found = engine(spark, sf_dir).nested("{ Nation { name customers <- Customer(acctbal >= 100 && acctbal <= 900000) order by acctbal desc limit 2 { key acctbal } } }")
    return _json(found, "customers")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, '{\"name\":\"' || r_name || '\"}' AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def nested_single(spark, sf_dir):
    return _json(engine(spark, sf_dir).nested("{ Nation { key region -> Region { name } } }"), "region")


_CHAIN = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(_CHAIN + " SELECT conv_id AS conv, CAST(max(n) - 1 AS BIGINT) AS hops, string_agg(CAST(turn AS VARCHAR), ' ' ORDER BY r) AS nodes, CAST(max(n) - 1 AS BIGINT) AS edges FROM o GROUP BY 1")
def path_nodes(spark, sf_dir):
    """The whole route through each conversation, node by node: from its first turn to its last."""
    g = shop(spark, sf_dir)
    turns = g.node("Turn")
    ends = g.rel("next")
    after, before = ends.select(F.col("src").alias("id"), F.lit(True).alias("goes")), ends.select(F.col("dst").alias("id"), F.lit(True).alias("comes"))
    place = F.when(F.col("goes") & F.col("comes"), "inner").when(F.col("goes"), "first").when(F.col("comes"), "last").otherwise("only")
    marked = turns.join(after, "id", "left").join(before, "id", "left").withColumn("role", place).drop("goes", "comes")
    e = Engine(replace(g, nodes=g.nodes | {"Turn": marked}))
    # only first turns start, as a route from every turn costs the square of a conversation
    found = e.nested('{ Turn(role = "first" || role = "only") { conv next *path -> Turn(role = "last" || role = "only") { turn } } }').filter("next is not null")
    return found.select("conv", F.col("next.hops").alias("hops"), F.array_join(F.transform("next.nodes", lambda x: x["turn"].cast("string")), " ").alias("nodes"), F.size("next.edges").cast("long").alias("edges"))


def _vector_scores(metric: str):
    def run(spark, sf_dir):
        v = shop(spark, sf_dir).node("Vec")
        return v.select("key", F.round(vectors.score(F.col("embedding"), vectors.literal(QUERY_VECTOR), metric), 6).alias("score"))

    return run


_Q = f"CAST({QUERY_VECTOR} AS DOUBLE[])"
query(f"SELECT vec_id AS key, round(list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings", "score_dot")(_vector_scores("dot"))
query(f"SELECT vec_id AS key, round(-list_distance(CAST(embedding AS DOUBLE[]), {_Q}), 6) AS score FROM embeddings", "score_l2")(_vector_scores("l2"))


@query("SELECT l_returnflag || l_linestatus AS code, count(*) AS n, (l_returnflag || l_linestatus) IN ('AF', 'AO', 'NF', 'NO', 'RO') AS valid FROM lineitem GROUP BY ALL")
def valid_codes(spark, sf_dir):
    """Country codes by the validator of qualified strings."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat("l_returnflag", "l_linestatus").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("code", "n", values.valid_string(F.col("code"), "iso2").alias("valid"))


@query("SELECT DISTINCT w AS word, CAST(damerau_levenshtein(w, 'smlal') AS INTEGER) AS edits FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE damerau_levenshtein(w, 'smlal') <= 2")
def close_words(spark, sf_dir):
    """Words of part names within two edits of a misspelt one."""
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))
    return search.close_words(words, "smlal", 2)


@query("SELECT p_partkey AS key, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) AS short FROM part")
def acronyms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), search.acronym(F.col("p_name")).alias("short"))


# --- time --------------------------------------------------------------------------------


def _series(unit: str, start: str, end: str):
    def run(spark, sf_dir):
        df = engine(spark, sf_dir).flat(f"{{ User {{ key <value> }} }} from {start} to {end} by {unit}")
        return df.select("key", F.explode("value").alias("x")).select("key", "x.time", "x.value")

    return run


for _unit, _from, _to in (("day", "2024-01-03", "2024-01-08"), ("month", "2024-01-01", "2024-03-15")):
    _SERIES = f"WITH {HISTORY}, s AS (SELECT unnest(generate_series(TIMESTAMP '{_from}', TIMESTAMP '{_to}', INTERVAL 1 {_unit.upper()})) AS t) SELECT u.user_id AS key, strftime(s.t, '%Y-%m-%dT%H:%M') AS time, (SELECT arg_max(v, h.t) FROM h WHERE h.user_id = u.user_id AND h.t <= s.t) AS value FROM u, s"
    query(_SERIES, f"series_{_unit}")(_series(_unit, _from, _to))

LIFE = """
schema {
  type Quarter { name: String starts: Date ends: Date period from starts to ends named by name }
  type Deal { key: Int born: Date died?: Date tags: String[] calendar quarter -> Quarter appears at born ends at died }
}
"""
_DEALS = "WITH d AS (SELECT o_orderkey AS key, o_orderdate AS born, CASE WHEN o_custkey % 5 > 0 THEN o_orderdate + INTERVAL 1 DAY * CAST(o_custkey % 400 + 1 AS INTEGER) END AS died, [o_orderstatus, o_orderpriority] AS tags FROM orders)"


def _deals(spark: SparkSession, sf_dir: str) -> Engine:
    """Orders as things that appear and end, with a calendar of quarters."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    born = F.col("o_orderdate").cast("timestamp")
    died = F.when(F.col("o_custkey") % 5 > 0, F.timestamp_add("DAY", (F.col("o_custkey") % 400 + 1).cast("int"), born))
    deals = o.select((F.lit(1 << 41) + F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("key"), born.alias("born"), died.alias("died"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return Engine(Graph(spark, parse_schema(LIFE), {"Deal": deals, "Quarter": shop(spark, sf_dir).node("Quarter")}))


def _deal_keys(name: str, text: str, sql: str) -> None:
    query(f"{_DEALS} SELECT key FROM d WHERE {sql}", name)(lambda spark, sf_dir: _deals(spark, sf_dir).flat(text))


_deal_keys("lifetimes", "{ Deal { key } } as of 1997-03-01", "born <= TIMESTAMP '1997-03-01' AND (died IS NULL OR died > TIMESTAMP '1997-03-01')")
_deal_keys("period_start", "{ Deal { key } } as of start of quarter \"1997Q2\"", "born <= TIMESTAMP '1997-04-01' AND (died IS NULL OR died > TIMESTAMP '1997-04-01')")
_deal_keys("list_equality", '{ Deal(tags = ["F", "1-URGENT"]) { key } }', "tags = ['F', '1-URGENT']")

@query(f"WITH {HISTORY} SELECT user_id AS key, arg_max(v, t) AS value FROM h GROUP BY 1")
def live_values(spark, sf_dir):
    """Live values from recorded ones: the latest in valid time."""
    return shop(spark, sf_dir).live_from_history().node("User").select("key", "value")


# --- loads -----------------------------------------------------------------------------------

_ITEMS = "schema { type Item { code: String size?: Int tags?: String[] next -> Item[] { gap?: Int } } } unique { Item { code } }"
_LINKS = "SELECT 'P' || p_partkey AS code, p_size AS size, 'P' || ((p_partkey + 1) % n.n) AS next_code, p_size % 7 AS next_gap FROM part, (SELECT max(p_partkey) + 1 AS n FROM part) n"


@query(f"WITH l AS ({_LINKS}) SELECT l.code, l.size, CASE WHEN p.p_partkey IS NULL THEN NULL ELSE l.next_code END AS next_code, CASE WHEN p.p_partkey IS NULL THEN NULL ELSE l.next_gap END AS next_gap FROM l LEFT JOIN part p ON l.next_code = 'P' || p.p_partkey")
def load_lines(spark, sf_dir):
    """Parts and their chain written as JSON lines, read in bulk, read back."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = part.agg(F.max("p_partkey") + 1).first()[0] or 1
    key, to = F.col("p_partkey"), (F.col("p_partkey") + 1) % n
    null = lambda kind: F.lit(None).cast(kind)
    code = F.concat(F.lit("P"), key.cast("string"))
    nodes = part.select(F.lit(0).alias("o"), key.alias("k"), F.to_json(F.struct(F.lit("node").alias("type"), (key + 1).alias("id"), F.array(F.lit("Item")).alias("labels"), F.struct(code.alias("code"), F.col("p_size").alias("size")).alias("props"))).alias("value"))
    known = part.select(key.alias("to"))
    rels = part.withColumn("to", to).join(known, "to", "left_semi")
    rels = rels.select(F.lit(1).alias("o"), key.alias("k"), F.to_json(F.struct(F.lit("rel").alias("type"), F.lit("next").alias("kind"), (key + 1).alias("from"), (F.col("to") + 1).alias("to"), F.struct((F.col("p_size") % 7).alias("gap")).alias("props"))).alias("value"))
    path = _unique_path(spark, "lines")
    nodes.unionByName(rels).repartitionByRange(1, "o", "k").sortWithinPartitions("o", "k").select("value").write.text(path)
    found = Engine(json_lines.read(spark, path, parse_schema(_ITEMS))).flat("{ Item { code size next -> Item { code &gap } } }")
    return plain(found)


@query("SELECT p_name AS name, p_size AS size, p_retailprice AS price FROM part")
def load_csv(spark, sf_dir):
    """Parts written as CSV, read back as cells and converted."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    path = _unique_path(spark, "csv")
    part.toDF("name", "size", "price").coalesce(1).write.csv(path, header=True, escape='"')
    cells = files.csv_file(spark, path)
    return cells.select(values.cell_as(F.col("name"), "String").alias("name"), values.cell_as(F.col("size"), "Int").alias("size"), values.cell_as(F.col("price"), "Float").alias("price"))


@query("SELECT n_name AS name, r_name AS region_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def saved_graph(spark, sf_dir):
    """A graph saved as a version, loaded again and queried."""
    g = _places(spark, sf_dir).graph
    path = _unique_path(spark, "graph")
    save(g, path)
    found = Engine(load(spark, path)).flat("{ Nation { name region -> Region { name } } }")
    return plain(found)


# --- writes ------------------------------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str) -> Engine:
    """Regions, nations and suppliers alone: what writes need not look through."""
    g = shop(spark, sf_dir)
    only = ("Region", "Nation", "Supplier")
    return Engine(replace(g, nodes={n: g.nodes[n] for n in only}, rels={k: g.rels[k] for k in ("IN_REGION", "BASED")}, history={}, intervals={}))


def _written(name: str, statements: tuple[str, ...], text: str, sql: str) -> None:
    def run(spark, sf_dir):
        e = _places(spark, sf_dir)
        for s in statements:
            e.run(s)
        return plain(e.flat(text))

    query(sql, name)(run)


_written("write_set", ("mutation { Supplier(key = 5) set acctbal: 0 }",), "{ Supplier { key acctbal } }", "SELECT s_suppkey AS key, CASE WHEN s_suppkey = 5 THEN 0.0 ELSE s_acctbal END AS acctbal FROM supplier")
_written("write_insert", ('mutation { Region(key: 77 && name: "NEW") { nations <- Nation(key: 770 && name: "N" && at: @point(1, 2)) } }',), "{ Region { key name nations <- Nation { name } } }", "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name, n_name AS nations_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 77, 'NEW', 'N'")
_written("write_link", ('mutation { Nation(key: 770 && name: "N" && at: @point(1, 2)) }', "mutation { Nation(key = 770) { region -> link Region(key = 1) } }"), "{ Nation { key region -> Region { name } } }", "SELECT CAST(n_nationkey AS BIGINT) AS key, r_name AS region_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 770, (SELECT r_name FROM region WHERE r_regionkey = 1)")
_written("write_unlink", ("mutation { Nation(key = 3) { region -> unlink Region(key = 3) } }",), "{ Nation { key region -> Region { name } } }", "SELECT CAST(n_nationkey AS BIGINT) AS key, CASE WHEN n_nationkey <> 3 THEN r_name END AS region_name FROM nation JOIN region ON r_regionkey = n_regionkey")
_written("write_delete", ("mutation { delete Supplier(acctbal < 0) { @detach key } }",), "{ Nation { key suppliers <- Supplier { key } } }", "SELECT CAST(n_nationkey AS BIGINT) AS key, s_suppkey AS suppliers_key FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= 0")


@query("SELECT 'nodes' AS what, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'relationships', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)")
def totals(spark, sf_dir):
    found = _places(spark, sf_dir).counts()
    return spark.createDataFrame(sorted(found.items()), "what string, n long")


@query("SELECT l_quantity AS quantity, count(*) AS n FROM lineitem GROUP BY 1")
def exported_relationships(spark, sf_dir):
    """Relationships with their properties, as they are exported."""
    g = shop(spark, sf_dir)
    rels = export_rels(replace(g, rels={"CONTAINS": g.rels["CONTAINS"]}))
    return rels.groupBy(F.get_json_object("props", "$.quantity").cast("double").alias("quantity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'u' || user_id AS key, CAST(count(*) AS BIGINT) AS version FROM events GROUP BY user_id")
def mirrored_feed(spark, sf_dir):
    """A feed of versions in two deliveries that overlap, mirrored: every key ends at its last version without gaps."""
    from pyspark.sql import Window

    from .streaming import changes

    w = Window.partitionBy("user_id").orderBy("event_id")
    feed = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.row_number().over(w).cast("long").alias("version"), F.col("event_id").cast("string").alias("payload"), "user_id")
    feed = staged(feed.drop("user_id"), "feed")
    none = spark.createDataFrame([], feed.schema)
    state, _ = changes.mirror(none, feed.filter("version <= 40"))
    state, _ = changes.mirror(staged(state, "state"), feed.filter("version > 20"))
    return state.select("key", "version")


# --- ties over two kinds of relationship, edits without a statement ------------------

_KEY = (1 << 40) - 1  # the bits of a node's id that hold its key
_STEPS = "n AS (SELECT max(p_partkey) + 1 AS n FROM part), e AS (SELECT DISTINCT a, b FROM (SELECT p_partkey AS a, unnest([(p_partkey + 1) % n, (p_partkey * 7 + 1) % n]) AS b FROM part, n)), h1 AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"


@query(
    f"WITH {_STEPS}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h2 AS (SELECT o, b AS p FROM h1 JOIN u ON p = a EXCEPT SELECT o, p FROM h1), "
    "h3 AS (SELECT o, b AS p FROM h2 JOIN u ON p = a EXCEPT (SELECT o, p FROM h1 UNION SELECT o, p FROM h2)), h AS (SELECT o, 1 AS hops FROM h1 UNION ALL SELECT o, 2 FROM h2 UNION ALL SELECT o, 3 FROM h3) "
    "SELECT o AS key, CAST(hops AS BIGINT) AS hops, count(*) AS parts FROM h GROUP BY 1, 2"
)
def proximity_hops(spark, sf_dir):
    """How many parts are one, two and three hops from each order: contained, or a step from those."""
    g = shop(spark, sf_dir)
    near = proximity(g.rel("CONTAINS").select(F.col("src").alias("start"), F.col("dst").alias("node")), g.rel("step"), 3)
    near = near.groupBy("start", F.col("hops").cast("long").alias("hops")).agg(F.count(F.lit(1)).alias("parts"))
    return near.select(F.col("start").bitwiseAND(_KEY).alias("key"), "hops", "parts")


@query(
    f"WITH {_STEPS}, asked AS (SELECT o_orderkey AS o, (o_orderkey * 13 + 5) % n AS t FROM orders, n), "
    "d1 AS (SELECT o, b AS p, min(a) AS q FROM h1 JOIN e ON p = a WHERE NOT EXISTS (SELECT 1 FROM h1 x WHERE x.o = h1.o AND x.p = b) GROUP BY 1, 2), "
    "d2 AS (SELECT o, b AS p, min(a) AS q FROM d1 JOIN e ON p = a WHERE NOT EXISTS (SELECT 1 FROM h1 x WHERE x.o = d1.o AND x.p = b) AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.o = d1.o AND x.p = b) GROUP BY 1, 2) "
    "SELECT asked.o AS key, CASE WHEN h1.o IS NOT NULL THEN 'named' WHEN x.o IS NOT NULL OR y.o IS NOT NULL THEN 'linked' ELSE 'none' END AS way, "
    "CASE WHEN h1.o IS NOT NULL THEN '' || t WHEN x.o IS NOT NULL THEN x.q || ' ' || t WHEN y.o IS NOT NULL THEN z.q || ' ' || y.q || ' ' || t END AS route "
    "FROM asked LEFT JOIN h1 ON h1.o = asked.o AND h1.p = t LEFT JOIN d1 x ON x.o = asked.o AND x.p = t LEFT JOIN d2 y ON y.o = asked.o AND y.p = t LEFT JOIN d1 z ON z.o = asked.o AND z.p = y.q"
)
def connection_ways(spark, sf_dir):
    """How each order is tied to one part, over what it contains and two steps on at most."""
    g = shop(spark, sf_dir)
    n = F.broadcast(g.node("Part").agg((F.max("key") + 1).alias("n")))
    asked = g.node("Order").crossJoin(n).select(F.col("id").alias("start"), (F.lit(NUMBERS["Part"] << 40) + (F.col("key") * 13 + 5) % F.col("n")).alias("node"))
    named = g.rel("CONTAINS").select(F.col("src").alias("start"), F.col("dst").alias("node"))
    found = connections(asked, named, g.rel("step"), most=2)
    route = F.array_join(F.transform("nodes", lambda x: x.bitwiseAND(_KEY).cast("string")), " ")
    return found.select(F.col("start").bitwiseAND(_KEY).alias("key"), "way", route.alias("route"))


@query("SELECT CAST(c_custkey % 25 AS BIGINT) AS nation, count(*) AS customers FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def direct_edits(spark, sf_dir):
    """Customers below zero and all ties to nations deleted, those that stay tied to other nations, by ids alone."""
    g = shop(spark, sf_dir)
    kept = replace(g, nodes={k: g.node(k) for k in ("Customer", "Nation")}, rels={"FROM": g.rel("FROM")}, history={}, intervals={})
    e = Engine(kept)
    e.delete_nodes(g.node("Customer").filter("acctbal < 0").select("id"))
    e.delete_relationships("FROM", g.rel("FROM").select("rel_id"))
    left = e.graph.node("Customer")
    e.connect("Customer", "nation", left.select(F.col("id").alias("src"), (F.lit(NUMBERS["Nation"] << 40) + F.col("key") % 25).alias("dst")))
    return e.graph.rel("FROM").groupBy(F.col("dst").bitwiseAND(_KEY).alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
