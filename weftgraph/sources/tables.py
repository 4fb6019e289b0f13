"""The driver's tables as one property graph.

Node ids are ``number of the type * 2^40 + key``, so they are unique over the
whole graph and ascend by key within a type.  Everything is a projection of
the tables: nothing is read before a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.parser import parse_schema
from .graph import Graph

SCHEMA = """
schema {
  type Region { key: Int name: String nations: IN_REGION <- Nation[] }
  type Nation {
    key: Int name: String at: Point
    region: IN_REGION -> Region
    customers: FROM <- Customer[]
    suppliers: BASED <- Supplier[]
  }
  type Customer {
    key: Int name: String acctbal: Float segment: String at: Point
    nation: FROM -> Nation
    orders: PLACED -> Order[]
    current: CURRENT -> <Order[]>
  }
  type Supplier { key: Int name: String acctbal: Float nation: BASED -> Nation ships: SHIPPED_BY <- Order[] }
  type Order {
    key: Int status: String total: Float date: Date priority: String
    customer: PLACED <- Customer
    parts: CONTAINS -> Part[] { quantity: Float price: Float }
    suppliers: SHIPPED_BY -> Supplier[]
  }
  type Part {
    key: Int name: String brand: String kind: String size: Int price: Float
    step -> Part[] { w: Int }
    orders: CONTAINS <- Order[]
  }
  type User { key: Int value?: <Float> }
  type Doc { key: Int text: String lang: String source: String chars: Int }
  type Vec { key: Int embedding: Vector<64> label: Int }
  type Turn { conv: Int turn: Int role: String text: String next -> Turn[] }
  type Quarter { name: String starts: Date ends: Date period from starts to ends named by name }
}
unique { Region { key } Nation { key } Customer { key } Part { key } }
"""
NUMBERS = {n: i + 1 for i, n in enumerate(("Region", "Nation", "Customer", "Supplier", "Order", "Part", "User", "Doc", "Vec", "Turn", "Quarter"))}
TURNS = 1 << 16  # turns of a conversation, at most


def code(name: str, key) -> F.Column:
    """The id of a node of a type by its key."""
    return (F.lit(NUMBERS[name] << 40) + key.cast("long")).cast("long")


def _place(key) -> F.Column:
    return F.struct((key * 37 % 120 - 60).cast("double").alias("lat"), (key * 73 % 360 - 180).cast("double").alias("lon"))


def quarters(spark: SparkSession) -> DataFrame:
    """The calendar quarters of 1995 to 2001."""
    months = spark.range(28).select(F.col("id"), F.make_date(F.lit(1995) + F.floor(F.col("id") / 4).cast("int"), (F.col("id") % 4 * 3 + 1).cast("int"), F.lit(1)).alias("d"))
    return months.select(code("Quarter", F.col("id")).alias("id"), F.concat(F.year("d"), F.lit("Q"), F.quarter("d")).alias("name"), F.col("d").cast("timestamp").alias("starts"), (F.add_months("d", 3).cast("timestamp") - F.expr("INTERVAL 1 SECOND")).alias("ends"))


def shop(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables in ``sf_dir``."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = F.col
    customer, orders, lineitem, part, events, turns = t("customer"), t("orders"), t("lineitem"), t("part"), t("events"), t("conversations")
    nodes = {
        "Region": t("region").select(code("Region", c("r_regionkey")).alias("id"), c("r_regionkey").alias("key"), c("r_name").alias("name")),
        "Nation": t("nation").select(code("Nation", c("n_nationkey")).alias("id"), c("n_nationkey").alias("key"), c("n_name").alias("name"), _place(c("n_nationkey")).alias("at")),
        "Customer": customer.select(code("Customer", c("c_custkey")).alias("id"), c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_acctbal").alias("acctbal"), c("c_mktsegment").alias("segment"), _place(c("c_custkey")).alias("at")),
        "Supplier": t("supplier").select(code("Supplier", c("s_suppkey")).alias("id"), c("s_suppkey").alias("key"), c("s_name").alias("name"), c("s_acctbal").alias("acctbal")),
        "Order": orders.select(code("Order", c("o_orderkey")).alias("id"), c("o_orderkey").alias("key"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("total"), c("o_orderdate").cast("timestamp").alias("date"), c("o_orderpriority").alias("priority")),
        "Part": part.select(code("Part", c("p_partkey")).alias("id"), c("p_partkey").alias("key"), c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_type").alias("kind"), c("p_size").alias("size"), c("p_retailprice").alias("price")),
        "User": events.select(c("user_id")).distinct().select(code("User", c("user_id")).alias("id"), c("user_id").alias("key"), F.lit(None).cast("double").alias("value")),
        "Doc": t("documents").select(code("Doc", c("doc_id")).alias("id"), c("doc_id").alias("key"), "text", "lang", "source", c("n_chars").alias("chars")),
        "Vec": t("embeddings").select(code("Vec", c("vec_id")).alias("id"), c("vec_id").alias("key"), "embedding", "label"),
        "Turn": turns.select(code("Turn", c("conv_id") * TURNS + c("turn")).alias("id"), c("conv_id").alias("conv"), "turn", "role", "text"),
        "Quarter": quarters(spark),
    }
    line = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    n = part.agg(F.max("p_partkey") + 1).first()[0] or 1
    own = c("p_partkey")
    steps = part.select(own, "p_size", F.posexplode(F.array((own + 1) % n, (own * 7 + 1) % n)).alias("k", "to"))
    rels = {
        "IN_REGION": t("nation").select(c("n_nationkey").alias("rel_id"), code("Nation", c("n_nationkey")).alias("src"), code("Region", c("n_regionkey")).alias("dst")),
        "FROM": customer.select(c("c_custkey").alias("rel_id"), code("Customer", c("c_custkey")).alias("src"), code("Nation", c("c_nationkey")).alias("dst")),
        "BASED": t("supplier").select(c("s_suppkey").alias("rel_id"), code("Supplier", c("s_suppkey")).alias("src"), code("Nation", c("s_nationkey")).alias("dst")),
        "PLACED": orders.select(c("o_orderkey").alias("rel_id"), code("Customer", c("o_custkey")).alias("src"), code("Order", c("o_orderkey")).alias("dst")),
        "CONTAINS": lineitem.select(line.alias("rel_id"), code("Order", c("l_orderkey")).alias("src"), code("Part", c("l_partkey")).alias("dst"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price")),
        "SHIPPED_BY": lineitem.select(line.alias("rel_id"), code("Order", c("l_orderkey")).alias("src"), code("Supplier", c("l_suppkey")).alias("dst")),
        "step": steps.select((own * 2 + c("k")).alias("rel_id"), code("Part", own).alias("src"), code("Part", c("to")).alias("dst"), (c("p_size") + 1).alias("w")),
        "next": _next(turns),
    }
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spans = orders.select("o_custkey", "o_orderkey", c("o_orderdate").cast("timestamp").alias("valid_from"), F.lead("o_orderdate").over(w).cast("timestamp").alias("valid_to"))
    spans = spans.select(c("o_orderkey").alias("rel_id"), code("Customer", c("o_custkey")).alias("src"), code("Order", c("o_orderkey")).alias("dst"), "valid_from", "valid_to")
    rels["CURRENT"] = spans.filter(c("valid_to").isNull()).drop("valid_from", "valid_to")
    second = F.date_trunc("second", c("ts")).cast("timestamp")
    value = events.groupBy("user_id", second.alias("at")).agg(F.max_by("value", "event_id").alias("value"))
    history = {("User", "value"): value.select(code("User", c("user_id")).alias("id"), "at", "value")}
    return Graph(spark, parse_schema(SCHEMA), nodes, rels, history, {"CURRENT": spans})


def _next(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("conv_id", "turn", F.lead("turn").over(w).alias("following")).filter("following is not null")
    at = lambda x: code("Turn", F.col("conv_id") * TURNS + F.col(x))
    return after.select((F.col("conv_id") * TURNS + F.col("turn")).alias("rel_id"), at("turn").alias("src"), at("following").alias("dst"))
