"""The registered queries of the graph engine, each with its SQL on the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import chunking as C
from ..operators import evaluate as E
from ..operators import extraction as X
from ..operators import graph as G
from ..operators import mapping as M
from ..session import partitions
from ..sources import store, tabular
from ..streaming import state as S
from .ontology import Entity, Field, Ontology

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Registers a function of a graph (or, with graph=False, of a session and folder) and its SQL, which may use the graph's tables."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, d: f(tabular.load(spark, d))) if graph else f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {tabular.SQL} {sql}" if graph else sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


OF_TYPE = "SELECT DISTINCT l.s, l.label AS name FROM labels l WHERE l.s IN (SELECT s FROM entity_types WHERE type = '{}')"


@query(OF_TYPE.format("Supplier"))
def list_names_type(g):
    return G.list_names(g, "Supplier")


@query(OF_TYPE.format("BUILDING"))
def list_names_subtype(g):
    return G.list_names(g, "BUILDING")


@query(OF_TYPE.format("Part") + " AND l.s IN (SELECT s FROM prop_values WHERE p = 'brand' AND key = lower('Brand#1'))")
def list_names_filter_literal(g):
    return G.list_names(g, "Part", {"brand": " Brand#1 "})


@query(OF_TYPE.format("Supplier") + " AND l.s IN (SELECT s FROM prop_values WHERE p = 'locatedIn' AND key = lower((SELECT n_name FROM nation WHERE n_nationkey = 3)))")
def list_names_filter_entity(g):
    return G.list_names(g, "Supplier", {"locatedIn": "Nation_3"})


@query(OF_TYPE.format("Party") + " AND l.s IN (SELECT s FROM prop_values WHERE p = 'locatedIn' AND contains(key, 'nation_1')) AND l.s IN (SELECT s FROM prop_values WHERE p = 'segment' AND contains(key, 'build'))")
def list_names_filter_multi(g):
    return G.list_names(g, "Party", {"locatedIn": "nation_1", "segment": "BUILD"}, match="contains")


@query(OF_TYPE.format("Part") + " AND l.s IN (SELECT s FROM mentioned_in JOIN books USING (book) WHERE edition = '5e' AND canon_type = 'canon')")
def list_names_provenance(g):
    return G.list_names(g, "Part", edition="5e", canon="canon")


@query("SELECT count(DISTINCT s) AS total FROM entity_types WHERE type = 'Party'")
def count_entities(g):
    return G.count_entities(g, "Party")


@query(OF_TYPE.format("Part") + " AND l.s IN (SELECT s FROM prop_values WHERE p = 'size' AND key = '7')")
def search_by_property_exact(g):
    return G.search_by_property(g, "Part", "size", "7")


@query(OF_TYPE.format("Part") + " AND l.s IN (SELECT s FROM prop_values WHERE p = 'brand' AND contains(key, '#2'))")
def search_by_property_contains(g):
    return G.search_by_property(g, "Part", "brand", "#2", "contains")


@query(
    "SELECT l.label AS name, min(n.score)::INT AS score, arg_min(n.text, n.score || n.text) AS hit, list_sort(list(DISTINCT t.type)) AS types FROM (SELECT s, text, CASE WHEN lower(text) = 'vendor 1' THEN 0 "
    "WHEN starts_with(lower(text), 'vendor 1') THEN 1 ELSE 2 END AS score FROM names WHERE contains(lower(text), 'vendor 1')) n JOIN labels l USING (s) JOIN entity_types t USING (s) GROUP BY l.label"
)
def search_entities_scored(g):
    return G.search_entities(g, "Vendor 1")


@query(
    "SELECT l.label AS name, min(CASE WHEN lower(text) = 'vendor 1' THEN 0 WHEN starts_with(lower(text), 'vendor 1') THEN 1 ELSE 2 END)::INT AS score FROM names n JOIN labels l USING (s) "
    "WHERE contains(lower(text), 'vendor 1') GROUP BY 1 ORDER BY score, length(name), lower(name), name LIMIT 10"
)
def search_entities_top(g):
    return G.by_relevance(G.search_entities(g, "Vendor 1").select("name", "score"), 10)


TEXT = "SELECT 'document/' || doc_id AS s, 'Document#' || doc_id AS name, text FROM documents"
SCORE = " + ".join(f"contains(lower(name || ' ' || text), '{w}')::INT" for w in ("thing", "ation", "entre"))


def _described(spark: SparkSession, d: str) -> tuple[G.Graph, DataFrame]:
    docs = table(spark, d, "documents").select(F.concat(F.lit("document/"), F.col("doc_id").cast("string")).alias("s"), "doc_id", "text")
    g = tabular.load(spark, d)
    g = G.replace(g, labels=docs.select("s", F.concat(F.lit("Document#"), F.col("doc_id").cast("string")).alias("label")))
    return g, docs.select("s", F.col("text").alias("description"))


@query(f"SELECT * FROM (SELECT s, name, ({SCORE})::INT AS score FROM ({TEXT})) WHERE score > 0", graph=False)
def search_text_scored(spark, d):
    g, text = _described(spark, d)
    return G.search_text(g, "Thing, ation or the entre?", described=text).select("s", "name", "score")


FIRST = "list_min(list_filter([instr(lower(text), 'thing'), instr(lower(text), 'ation'), instr(lower(text), 'entre')], lambda k: k > 0))"


@query(
    f"SELECT s, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, 300) || CASE WHEN b + 299 < length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT s, text, greatest(coalesce({FIRST}, 1) - 120, 1) AS b, ({SCORE}) AS score FROM ({TEXT})) WHERE score > 0",
    graph=False,
)
def search_text_snippet(spark, d):
    g, text = _described(spark, d)
    return G.search_text(g, "Thing, ation or the entre?", described=text).select("s", "snippet")


@query("SELECT l.s, l.label, list_sort(list(DISTINCT t.type)) AS types, lower(l.label) = 'vendor 7' AS by_label FROM labels l JOIN entity_types t USING (s) WHERE l.s IN (SELECT s FROM names WHERE lower(text) = 'vendor 7') GROUP BY 1, 2")
def resolve_name(g):
    return G.resolve(g, " Vendor 7 ")


@query('SELECT s, p, list_sort(list(DISTINCT value)) AS "values" FROM facts GROUP BY s, p')
def entity_facts(g):
    return G.entity_facts(g, g.labels)


BOTH = "(SELECT s, p, 'out' AS dir, o AS far FROM edges UNION ALL SELECT o, p, 'in', s FROM edges)"


@query(f"SELECT b.s, p, dir, l.label AS other, list_sort(list(DISTINCT t.type)) AS types FROM {BOTH} b JOIN labels l ON l.s = far LEFT JOIN entity_types t ON t.s = far WHERE starts_with(b.s, 'nation/') GROUP BY ALL")
def entity_edges_both_dirs(g):
    return G.entity_edges(g, G.of_type(g, "Nation"))


@query(
    f"SELECT b.s, CASE p || dir WHEN 'containsout' THEN 'contains' WHEN 'containsin' THEN 'containedIn' WHEN 'locatedInout' THEN 'basedIn' WHEN 'locatedInin' THEN 'residents' WHEN 'suppliesout' THEN 'supplies' WHEN 'suppliesin' THEN 'suppliers' "
    f"WHEN 'capitalOfout' THEN 'capitalOf' ELSE p || ' (inverse)' END AS relation, l.label AS other, list_sort(list(DISTINCT t.type)) AS types FROM {BOTH} b JOIN labels l ON l.s = far LEFT JOIN entity_types t ON t.s = far WHERE starts_with(b.s, 'nation/') GROUP BY ALL"
)
def entity_edges_grouped(g):
    return G.grouped_edges(g, G.of_type(g, "Nation"))


@query("SELECT e.s, l.label AS other, list_sort(list(DISTINCT t.type)) AS types FROM edges e JOIN labels l ON l.s = e.o LEFT JOIN entity_types t ON t.s = e.o WHERE p = 'supplies' GROUP BY 1, 2")
def relationship_out(g):
    return G.relationship(g, "supplies")


@query("SELECT e.o AS s, l.label AS other, list_sort(list(DISTINCT t.type)) AS types FROM edges e JOIN labels l ON l.s = e.s LEFT JOIN entity_types t ON t.s = e.s WHERE p = 'locatedIn' GROUP BY 1, 2")
def relationship_in(g):
    return G.relationship(g, "locatedIn", "in")


@query("SELECT s, count(DISTINCT o) AS total FROM edges WHERE p = 'supplies' AND o IN (SELECT s FROM labels) GROUP BY s")
def relationship_total(g):
    return G.relationship_total(g, "supplies")


CAPITALS = """
, st AS (SELECT s AS city, value AS status FROM facts WHERE p = 'capitalStatus'), said AS (SELECT s AS city, o AS entity FROM edges WHERE p = 'capitalOf'),
between_ AS (SELECT a.ancestor AS entity, b.descendant AS city FROM closure a JOIN entity_types n ON n.s = a.descendant AND n.type = 'Nation' JOIN closure b ON b.ancestor = a.descendant),
capitals AS (SELECT entity, city, coalesce(status, 'current') AS status FROM said LEFT JOIN st USING (city)
  UNION SELECT c.ancestor, st.city, st.status FROM st JOIN closure c ON c.descendant = st.city WHERE st.city NOT IN (SELECT city FROM said) AND (c.ancestor, st.city) NOT IN (SELECT entity, city FROM between_))
SELECT entity, city FROM capitals WHERE status = '{}'
"""


@query(CAPITALS.format("current"))
def capital_current(g):
    return G.capitals(g.with_closure()).where("status = 'current'").select("entity", "city")


@query(CAPITALS.format("former"))
def capital_former(g):
    return G.capitals(g.with_closure()).where("status = 'former'").select("entity", "city")


@query("SELECT ancestor, descendant, depth::INT AS depth FROM closure")
def closure_all(g):
    return g.with_closure().closure


@query("SELECT s, o FROM edges WHERE p = 'contains' AND starts_with(s, 'region/') AND starts_with(o, 'nation/')")
def induced_edges(g):
    return G.induced_edges(g, G.of_type(g, "Place"))


@query("SELECT e.s, l.label AS other, list_sort(list(DISTINCT t.type)) AS types FROM edges e JOIN labels l ON l.s = e.o LEFT JOIN entity_types t ON t.s = e.o WHERE p = 'contains' GROUP BY 1, 2")
def children_direct(g):
    return G.children(g)


@query("SELECT c.ancestor AS s, l.label AS other, list_sort(list(DISTINCT t.type)) AS types FROM closure c JOIN labels l ON l.s = c.descendant LEFT JOIN entity_types t ON t.s = c.descendant GROUP BY 1, 2")
def children_all(g):
    return G.children(g.with_closure(), "all")


@query("SELECT s, title, edition, canon_type, list_sort(list(DISTINCT page)) AS pages FROM mentions JOIN books USING (book) GROUP BY 1, 2, 3, 4")
def sources_pages(g):
    return G.sources(g)


@query("SELECT title, edition, canon_type, count(DISTINCT s) AS entities FROM books LEFT JOIN mentioned_in USING (book) GROUP BY 1, 2, 3")
def list_sources(g):
    return G.list_sources(g)


PARENT_ROWS = "(VALUES " + ", ".join(f"('{t}', [{', '.join(repr(a) for a in tabular.ONTOLOGY.ancestors(t))}]::VARCHAR[], '{(tabular.ONTOLOGY.ancestors(t) or [t])[-1]}', {'NULL' if p is None else repr(p)})" for t, p in tabular.PARENTS.items()) + ") d(type, ancestors, root, parent)"


@query(f"SELECT s, list_sort(list_filter(t, lambda x: NOT list_contains(a, x))) AS types FROM (SELECT s, list(DISTINCT e.type) AS t, flatten(list(coalesce(ancestors, []))) AS a FROM entity_types e LEFT JOIN {PARENT_ROWS} ON d.type = e.type GROUP BY s)")
def most_specific_types(g):
    return G.most_specific_types(g)


@query(f"SELECT root, list_sort(list(type)) AS types FROM {PARENT_ROWS} WHERE parent IS NOT NULL GROUP BY root")
def type_tree(g):
    return G.type_tree(g)


@query("SELECT * FROM (VALUES ('contains', 'out', 'contains'), ('contains', 'in', 'containedIn'), ('locatedIn', 'out', 'basedIn'), ('locatedIn', 'in', 'residents'), ('supplies', 'out', 'supplies'), ('supplies', 'in', 'suppliers'), ('capitalOf', 'out', 'capitalOf')) v(predicate, direction, api_name)")
def edge_api_names(g):
    return G.edge_names(g)


@query("SELECT s, label AS name FROM labels WHERE s IN (SELECT s FROM entity_types WHERE type = 'Customer') ORDER BY lower(label), label, s LIMIT 50 OFFSET 100")
def paging_window(g):
    return G.page(G.list_names(g, "Customer"), 50, 100)


# ---- names, years, pages -------------------------------------------------------------------------------------------------------------

STRANGE = "(SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ' ' || p_name || '''s - part! ' WHEN 1 THEN 'Unknown' WHEN 2 THEN ' N/A ' WHEN 3 THEN '' WHEN 4 THEN upper(p_name) || '/x' ELSE p_name END AS name FROM part)"


def _strange(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit(" "), n, F.lit("'s - part! "))).when(k == 1, "Unknown").when(k == 2, " N/A ").when(k == 3, "").when(k == 4, F.concat(F.upper(n), F.lit("/x"))).otherwise(n)
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query(f"SELECT p_partkey, regexp_replace(trim(regexp_replace(name, '[^\\w\\s-]', '', 'g')), '[\\s-]+', '_', 'g') AS slug FROM {STRANGE}", graph=False)
def slugify(spark, d):
    return _strange(spark, d).select("p_partkey", N.slug(F.col("name")).alias("slug"))


@query(f"SELECT p_partkey, CASE WHEN trim(name) <> '' AND lower(trim(name)) NOT IN ('null', 'none', 'n/a', 'unknown', 'unnamed', 'name', 'entity name') THEN trim(name) END AS name FROM {STRANGE}", graph=False)
def valid_name(spark, d):
    return _strange(spark, d).select("p_partkey", N.clean_name(F.col("name")).alias("name"))


YEARS = "CASE o_orderkey % 6 WHEN 0 THEN '-1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ' YK' WHEN 1 THEN o_orderkey || ' years ago' WHEN 2 THEN 'true' WHEN 3 THEN 'year ' || o_orderkey WHEN 4 THEN 'none' ELSE o_orderkey::VARCHAR END"


@query(f"SELECT o_orderkey, CASE WHEN lower(y) NOT IN ('true', 'false') AND NOT contains(lower(y), 'ago') THEN TRY_CAST(nullif(regexp_extract(replace(y, ',', ''), '-?\\d+'), '') AS BIGINT) END AS year FROM (SELECT o_orderkey, {YEARS} AS y FROM orders)", graph=False)
def parse_year(spark, d):
    k, t = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    y = F.when(k == 0, F.concat(F.lit("-1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" YK"))).when(k == 1, F.concat(t, F.lit(" years ago"))).when(k == 2, "true").when(k == 3, F.concat(F.lit("year "), t)).when(k == 4, "none").otherwise(t)
    return table(spark, d, "orders").select("o_orderkey", N.year(y).alias("year"))


@query(
    "SELECT l_orderkey, list_transform(list_sort(list(DISTINCT struct_pack(none := n IS NULL, n := coalesce(n, 0), p := p))), lambda x: x.p) AS pages FROM (SELECT l_orderkey, p, TRY_CAST(nullif(regexp_extract(p, '\\d+'), '') AS BIGINT) AS n "
    "FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'cover' ELSE 'p. ' || (l_partkey % 150) END AS p FROM lineitem)) GROUP BY 1",
    graph=False,
)
def page_sort(spark, d):
    p = F.when(F.col("l_linenumber") == 1, "cover").otherwise(F.concat(F.lit("p. "), (F.col("l_partkey") % 150).cast("string")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(N.sorted_pages(F.collect_set(p)).alias("pages"))


# ---- mapping -------------------------------------------------------------------------------------------------------------------------

LATTICE = {"Thing": None, "Order": "Thing", "Open": "Order", "Filled": "Order", "Pending": "Order", "Party": None, "Customer": "Party"}
ORDERS = Ontology(
    LATTICE, (),
    (
        Entity("orders", "Order", (Field("total", "total", "literal"), Field("priority", "priority", "enum", ("1-urgent", "2-high")), Field("year", "year", "integer"), Field("customer", "placedBy", "out"), Field("tags", "tag", "list"), Field("parts", "includes", "out_list"), Field("region", "contains", "in"), Field("peer", "peerOf", "both")), "status", {"O": "Open", "F": "Filled", "P": "Pending"}, related={"ally": ("alliedWith", False), "enemy": ("enemyOf", True)}),
        Entity("customers", "Customer", (Field("segment", "segment", "literal"),)),
    ),
)
FIELDS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """Orders as extracted JSON: a chunk for each order, a document for some customers, some replies broken or empty."""
    o = table(spark, d, "orders").repartition(partitions(spark), "o_orderkey")  # replies come in many files; this table may be one row group
    text = lambda c: F.col(c).cast("string")
    order = F.struct(
        F.concat(F.lit("Order "), text("o_orderkey")).alias("name"), F.col("o_orderstatus").alias("status"), text("o_orderkey").alias("total"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"),
        F.concat(F.lit("Customer "), text("o_custkey")).alias("customer"), F.array(F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")), F.lit("all")).alias("tags"),
        F.array(F.concat(F.lit("Ord "), text("o_orderkey")), F.concat(F.lit("Order "), text("o_orderkey"))).alias("aliases"), F.array(F.concat(F.lit("Part "), (F.col("o_orderkey") % 5).cast("string")), F.lit("unknown"), F.lit("Bolt")).alias("parts"), F.concat(F.lit("Region "), (F.col("o_orderkey") % 4).cast("string")).alias("region"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("p. 1"), F.lit(" "), F.lit("p. 2"))).alias("page_references"), F.when(F.col("o_orderkey") % 4 == 1, " 9 ").alias("page_reference"), F.concat(F.lit("Order "), (F.col("o_orderkey") + 1).cast("string")).alias("peer"), F.array(F.struct(F.concat(F.lit("Customer "), text("o_custkey")).alias("target"), F.when(F.col("o_orderkey") % 2 == 0, "ally").otherwise("enemy").alias("type"))).alias("relationships"),
    )
    body = F.when(F.col("o_orderkey") % 10 == 8, "not json").when(F.col("o_orderkey") % 10 == 9, '{"orders": []}').otherwise(F.to_json(F.struct(F.array(order).alias("orders"))))
    return o.select(F.concat(F.lit("doc"), (F.col("o_custkey") % 50).cast("string")).alias("doc_id"), F.col("o_orderkey").cast("int").alias("chunk_idx"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 7).cast("string").alias("page"), F.concat(F.lit("book/"), "o_orderpriority").alias("book"), body.alias("body"))


KEPT = "(SELECT *, 'Order_' || o_orderkey AS me, 'doc' || (o_custkey % 50) AS doc_id FROM orders WHERE o_orderkey % 10 < 8)"


@query(
    f"SELECT DISTINCT doc_id, me AS s, p, o, datatype FROM (SELECT doc_id, me, 'total' AS p, o_orderkey::VARCHAR AS o, 'string' AS datatype FROM {KEPT} UNION ALL SELECT doc_id, me, 'priority', lower(o_orderpriority), 'string' FROM {KEPT} WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') "
    f"UNION ALL SELECT doc_id, me, 'year', year(o_orderdate)::VARCHAR, 'integer' FROM {KEPT} UNION ALL SELECT doc_id, me, 'tag', unnest(['t' || (o_orderkey % 3), 'all']), 'string' FROM {KEPT} UNION ALL SELECT doc_id, me, 'alias', 'Ord ' || o_orderkey, 'string' FROM {KEPT})",
    graph=False,
)
def unpivot_literals(spark, d):
    said = {f.predicate for f in ORDERS.entities[0].fields if f.kind in ("literal", "enum", "integer", "list")} | {"alias"}
    return M.quads(_extracted(spark, d), ORDERS, said.__contains__, ("orders",)).where("o_kind = 'lit'").select("doc_id", "s", "p", "o", "datatype")


@query(f"SELECT DISTINCT doc_id, s, o FROM (SELECT doc_id, me AS s, 'Order_' || (o_orderkey + 1) AS o FROM {KEPT} UNION ALL SELECT doc_id, 'Order_' || (o_orderkey + 1), me FROM {KEPT})", graph=False)
def symmetric_edges(spark, d):
    return M.quads(_extracted(spark, d), ORDERS, ("peerOf",).__contains__, ("orders",)).select("doc_id", "s", "o")


@query(
    f"SELECT DISTINCT doc_id, s, p, o FROM (SELECT doc_id, me AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'alliedWith' ELSE 'enemyOf' END AS p, 'Customer_' || o_custkey AS o FROM {KEPT} UNION ALL SELECT doc_id, 'Customer_' || o_custkey, 'enemyOf', me FROM {KEPT} WHERE o_orderkey % 2 = 1)",
    graph=False,
)
def typed_relationships(spark, d):
    return M.quads(_extracted(spark, d), ORDERS, ("alliedWith", "enemyOf").__contains__, ("orders",)).select("doc_id", "s", "p", "o")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 5 == 0, "Order").when(F.col("o_orderkey") % 11 == 0, "Thing").otherwise(F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", "Filled").otherwise("Pending"))
    return table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("slug"), F.col("o_orderkey").alias("ord"), F.lit(0).alias("chunk_idx"), F.lit(0).alias("pos"), kind.alias("class"))


FOLD = """
WITH a AS (SELECT 'c' || o_custkey AS slug, o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN 'Order' WHEN o_orderkey % 11 = 0 THEN 'Thing' WHEN o_orderstatus = 'O' THEN 'Open' WHEN o_orderstatus = 'F' THEN 'Filled' ELSE 'Pending' END AS class FROM orders),
narrow AS (SELECT slug, arg_min(class, ord) AS leaf FROM a WHERE class NOT IN ('Order', 'Thing') GROUP BY slug),
wide AS (SELECT slug, CASE WHEN bool_or(class = 'Order') THEN 'Order' ELSE 'Thing' END AS top FROM a GROUP BY slug)
"""


@query(FOLD + "SELECT w.slug, coalesce(leaf, top) AS class FROM wide w LEFT JOIN narrow n ON n.slug = w.slug", graph=False)
def type_fold(spark, d):
    onto = Ontology(LATTICE, (), ())
    return M.type_fold(_arrivals(spark, d), onto).select("slug", "class")


@query(FOLD + "SELECT DISTINCT a.slug, n.leaf AS existing, a.class AS refused FROM a JOIN narrow n ON n.slug = a.slug WHERE a.class NOT IN ('Order', 'Thing') AND a.class <> n.leaf", graph=False)
def type_conflicts(spark, d):
    return M.type_conflicts(M.type_fold(_arrivals(spark, d), Ontology(LATTICE, (), ())))


# ---- chunks --------------------------------------------------------------------------------------------------------------------------


@query(
    "SELECT doc_id::VARCHAR AS doc_id, (n - 1)::INT AS line_no, CASE WHEN t = '' THEN 'blank' WHEN starts_with(t, '|') THEN 'table' WHEN starts_with(t, '```') THEN 'fence' WHEN regexp_matches(t, '^(\\*\\*\\d{1,4}\\*\\*|\\d{1,4})$') THEN 'footer' ELSE 'text' END AS kind "
    "FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, trim(unnest(l)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    graph=False,
)
def chunk_lines_classified(spark, d):
    return C.classified(C.lines(table(spark, d, "documents"))).select("doc_id", "line_no", "kind")


@query(
    "SELECT doc_id, page, toc_title FROM (SELECT 'c' || (o_custkey % 20) AS doc_id, (o_orderkey % 500)::INT AS page FROM orders GROUP BY ALL) p, LATERAL (SELECT 'T' || t AS toc_title FROM range(0, 40) r(t) WHERE t * 12 + 1 <= p.page ORDER BY t DESC LIMIT 1)",
    graph=False,
)
def chunk_toc_range_join(spark, d):
    pages = table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("doc_id"), (F.col("o_orderkey") % 500).cast("int").alias("page")).distinct()
    toc = pages.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("ord"))
    ranges = C.toc_ranges(toc.select("doc_id", "ord", F.concat(F.lit("T"), F.col("ord").cast("string")).alias("title"), (F.col("ord") * 12 + 1).alias("start")))
    return C.toc_of_page(pages, ranges)


@query("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS ok FROM events", graph=False)
def extract_json_parse(spark, d):
    return X.parsed(table(spark, d, "events"), [], "props").select("event_id", "ok")


# ---- state ---------------------------------------------------------------------------------------------------------------------------

KINDS = "list_position(list_sort((SELECT list(DISTINCT event_type) FROM events)), event_type)"
LOG = "(SELECT lpad(user_id::VARCHAR, 8, '0') AS document_id, CASE event_id % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CONVERTING_PDF' WHEN 2 THEN 'MARKDOWN_READY' WHEN 3 THEN 'CLASSIFYING_SECTIONS' WHEN 4 THEN 'EXTRACTING_ENTITIES' WHEN 5 THEN 'MAPPING_TO_ONTOLOGY' WHEN 6 THEN 'LOADING_GRAPH' WHEN 7 THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts AS updated_at, event_id FROM events)"
LAST = f"(SELECT document_id, arg_max(status, (updated_at, event_id)) AS status, max(updated_at) AS updated_at FROM {LOG} GROUP BY 1)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in S.STATUSES]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("document_id"), "event_id", status.alias("status"), F.col("ts").alias("updated_at"))


@query(f"SELECT * FROM {LAST}", graph=False)
def state_latest(spark, d):
    return S.latest(_log(spark, d)).select("document_id", "status", "updated_at")


@query(f"SELECT document_id, status FROM {LAST} ORDER BY document_id LIMIT 10 OFFSET 20", graph=False)
def state_page(spark, d):
    return S.listed(_log(spark, d), 3).select("document_id", "status")


@query(f"SELECT document_id FROM {LAST} WHERE status NOT IN ('PENDING', 'MARKDOWN_READY', 'COMPLETED', 'FAILED') AND date_diff('second', date_trunc('second', updated_at), date_trunc('second', (SELECT max(ts) FROM events))) > 600", graph=False)
def state_stale(spark, d):
    log = _log(spark, d)
    now = log.agg(F.max("updated_at").alias("_now"))  # one row beside each of the log's
    return S.stale(log.join(F.broadcast(now)), F.col("_now")).select("document_id")


@query(f"SELECT document_id, status FROM {LAST} WHERE status IN ('MARKDOWN_READY', 'CLASSIFYING_SECTIONS', 'EXTRACTING_ENTITIES', 'MAPPING_TO_ONTOLOGY', 'LOADING_GRAPH')", graph=False)
def state_claim_order(spark, d):
    return S.graph_candidates(_log(spark, d)).select("document_id", "status")


@query(f"SELECT document_id, 'PENDING' AS status FROM {LAST} WHERE status = 'FAILED'", graph=False)
def state_requeue(spark, d):
    log = _log(spark, d)
    return S.requeue(log, log, F.lit("2030-01-01").cast("timestamp_ntz")).select("document_id", "status")


# ---- evaluation ----------------------------------------------------------------------------------------------------------------------


@query(
    "WITH g AS (SELECT DISTINCT source AS question, doc_id FROM documents WHERE length(text) > 1500), e AS (SELECT DISTINCT source AS question, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), "
    "s AS (SELECT question, count(*) FILTER (g.doc_id IS NOT NULL AND e.doc_id IS NOT NULL) AS hits, count(*) FILTER (e.doc_id IS NULL) AS extra, count(*) FILTER (g.doc_id IS NULL) AS missed FROM g FULL JOIN e USING (question, doc_id) GROUP BY 1), "
    "r AS (SELECT *, CASE WHEN hits + extra > 0 THEN hits / (hits + extra) ELSE 0 END AS p, CASE WHEN hits + missed > 0 THEN hits / (hits + missed) ELSE 0 END AS r FROM s) "
    "SELECT question, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, hits, extra, missed FROM r",
    graph=False,
)
def score_prf(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("question"), F.col("doc_id").cast("string").alias("item"), "doc_id", F.length("text").alias("n"))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return E.score(docs.where("n > 1500"), docs.join(good, "doc_id", "left_semi"))
