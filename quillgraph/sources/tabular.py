"""A graph from star-schema tables: places, parties, parts and orders, so that each graph query has an answer that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.ontology import Ontology, Relation

RELATIONS = (
    Relation("contains", "contains", "out"), Relation("containedIn", "contains", "in"), Relation("basedIn", "locatedIn", "out"), Relation("residents", "locatedIn", "in"), Relation("supplies", "supplies", "out"),
    Relation("suppliers", "supplies", "in"), Relation("vendors", "supplies", "in"), Relation("capital", None, "derived", "capital", "current"), Relation("formerCapitals", None, "derived", "capital", "former"), Relation("capitalOf", "capitalOf", "out"),
)
PARENTS: dict[str, str | None] = {"Place": None, "Region": "Place", "Nation": "Place", "Party": None, "Customer": "Party", "Supplier": "Party", "Part": None, "Document": None}
PARENTS |= {s: "Customer" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
ONTOLOGY = Ontology(PARENTS, RELATIONS, ())


def load(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    uri = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    region, nation, customer, supplier, part = (t(x) for x in ("region", "nation", "customer", "supplier", "part"))
    lines, orders = t("lineitem"), t("orders")

    def union(*rows: DataFrame) -> DataFrame:
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    kinds = [("region", region, "r_regionkey", "r_name"), ("nation", nation, "n_nationkey", "n_name"), ("customer", customer, "c_custkey", "c_name"), ("supplier", supplier, "s_suppkey", "s_name"), ("part", part, "p_partkey", "p_name")]
    labels = union(*[df.select(uri(k, key).alias("s"), F.col(name).alias("label")) for k, df, key, name in kinds])
    typed = {"region": ["Place", "Region"], "nation": ["Place", "Nation"], "customer": ["Party", "Customer"], "supplier": ["Party", "Supplier"], "part": ["Part"]}
    types = union(
        *[df.select(uri(k, key).alias("s"), F.explode(F.array(*[F.lit(x) for x in typed[k]])).alias("type")) for k, df, key, _ in kinds],
        customer.select(uri("customer", "c_custkey").alias("s"), F.col("c_mktsegment").alias("type")),
    )
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    ranked = supplier.select("s_suppkey", "s_nationkey", rank.alias("r")).where("r <= 2")
    edge = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    edges = union(
        edge(nation, uri("region", "n_regionkey"), "contains", uri("nation", "n_nationkey")),
        edge(customer, uri("nation", "c_nationkey"), "contains", uri("customer", "c_custkey")),
        edge(supplier, uri("nation", "s_nationkey"), "contains", uri("supplier", "s_suppkey")),
        edge(customer, uri("customer", "c_custkey"), "locatedIn", uri("nation", "c_nationkey")),
        edge(supplier, uri("supplier", "s_suppkey"), "locatedIn", uri("nation", "s_nationkey")),
        edge(lines.select("l_suppkey", "l_partkey").distinct(), uri("supplier", "l_suppkey"), "supplies", uri("part", "l_partkey")),
        edge(ranked.where("r = 1 and s_nationkey % 2 = 0"), uri("supplier", "s_suppkey"), "capitalOf", uri("nation", "s_nationkey")),
    )
    facts = union(
        customer.select(uri("customer", "c_custkey").alias("s"), F.lit("segment").alias("p"), F.col("c_mktsegment").alias("value")),
        part.select(uri("part", "p_partkey").alias("s"), F.lit("brand").alias("p"), F.col("p_brand").alias("value")),
        part.select(uri("part", "p_partkey").alias("s"), F.lit("size").alias("p"), F.col("p_size").cast("string").alias("value")),
        ranked.select(uri("supplier", "s_suppkey").alias("s"), F.lit("capitalStatus").alias("p"), F.when(F.col("r") == 1, "current").otherwise("former").alias("value")),
    )
    priority = F.col("o_orderpriority")
    book = F.concat(F.lit("book/"), priority)
    books = orders.select("o_orderpriority").distinct().select(
        book.alias("book"), priority.alias("title"), F.when(F.substring(priority, 1, 1).isin("1", "2"), "5e").otherwise("3e").alias("edition"), F.when(F.substring(priority, 1, 1).isin("1", "3"), "canon").otherwise("kanon").alias("canon_type")
    )
    seen = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(uri("part", "l_partkey").alias("s"), book.alias("book"), F.col("l_linenumber").cast("string").alias("page"))
    aliases = supplier.select(uri("supplier", "s_suppkey").alias("s"), F.concat(F.lit("Vendor "), F.col("s_suppkey").cast("string")).alias("alias"))
    return Graph(labels, aliases, types, edges, facts, seen.distinct(), seen.select("s", "book").distinct(), books, ONTOLOGY.type_dim(spark), ONTOLOGY.rel_dim(spark))


#: The same tables for SQL.
SQL = """
labels AS (SELECT 'region/' || r_regionkey AS s, r_name AS label FROM region UNION ALL SELECT 'nation/' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, c_name FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'part/' || p_partkey, p_name FROM part),
aliases AS (SELECT 'supplier/' || s_suppkey AS s, 'Vendor ' || s_suppkey AS alias FROM supplier),
names AS (SELECT s, label AS text FROM labels UNION ALL SELECT s, alias FROM aliases),
entity_types AS (SELECT 'region/' || r_regionkey AS s, unnest(['Place', 'Region']) AS type FROM region UNION ALL SELECT 'nation/' || n_nationkey, unnest(['Place', 'Nation']) FROM nation
  UNION ALL SELECT 'customer/' || c_custkey, unnest(['Party', 'Customer', c_mktsegment]) FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, unnest(['Party', 'Supplier']) FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, 'Part' FROM part),
ranked AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier QUALIFY r <= 2),
edges AS (SELECT 'region/' || n_regionkey AS s, 'contains' AS p, 'nation/' || n_nationkey AS o FROM nation UNION ALL SELECT 'nation/' || c_nationkey, 'contains', 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'nation/' || s_nationkey, 'contains', 'supplier/' || s_suppkey FROM supplier UNION ALL SELECT 'customer/' || c_custkey, 'locatedIn', 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'locatedIn', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 'supplier/' || l_suppkey, 'supplies', 'part/' || l_partkey FROM lineitem
  UNION ALL SELECT 'supplier/' || s_suppkey, 'capitalOf', 'nation/' || s_nationkey FROM ranked WHERE r = 1 AND s_nationkey % 2 = 0),
facts AS (SELECT 'customer/' || c_custkey AS s, 'segment' AS p, c_mktsegment AS value FROM customer UNION ALL SELECT 'part/' || p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT 'part/' || p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL SELECT 'supplier/' || s_suppkey, 'capitalStatus', CASE WHEN r = 1 THEN 'current' ELSE 'former' END FROM ranked),
books AS (SELECT DISTINCT 'book/' || o_orderpriority AS book, o_orderpriority AS title, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN '5e' ELSE '3e' END AS edition,
  CASE WHEN o_orderpriority[1] IN ('1', '3') THEN 'canon' ELSE 'kanon' END AS canon_type FROM orders),
mentions AS (SELECT DISTINCT 'part/' || l_partkey AS s, 'book/' || o_orderpriority AS book, l_linenumber::VARCHAR AS page FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
mentioned_in AS (SELECT DISTINCT s, book FROM mentions),
prop_values AS (SELECT s, p, lower(value) AS key FROM facts UNION ALL SELECT e.s, e.p, lower(coalesce(l.label, e.o)) FROM edges e LEFT JOIN labels l ON l.s = e.o),
walk AS (SELECT s AS ancestor, o AS descendant, 1 AS depth FROM edges WHERE p = 'contains' UNION ALL SELECT w.ancestor, e.o, w.depth + 1 FROM walk w JOIN edges e ON e.p = 'contains' AND e.s = w.descendant WHERE w.depth < 8),
closure AS (SELECT ancestor, descendant, min(depth) AS depth FROM walk GROUP BY ALL)
"""
