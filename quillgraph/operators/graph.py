"""The graph as tables, and its queries as plans over them.

Nothing here runs a job, but `transitive_closure`, which loops until no pair is new, `ancestors` and `nearest_first`, which use it, and `reachable`.
Requests become literals; names compare by lower() of both sides. Tables that are empty give empty results, counts of them are 0. Null names,
values and ends of links match nothing; an entity with several labels has a row for each, one without a label is counted but not listed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sorted_pages
from ..sources.store import cut


@dataclass(frozen=True)
class Graph:
    labels: DataFrame  # s, label
    aliases: DataFrame  # s, alias
    entity_types: DataFrame  # s, type (with all ancestors)
    edges: DataFrame  # s, p, o
    facts: DataFrame  # s, p, value
    mentions: DataFrame  # s, book, page
    mentioned_in: DataFrame  # s, book
    books: DataFrame  # book, title, edition, canon_type
    type_dim: DataFrame  # type, parent, ancestors, root
    rel_dim: DataFrame  # name, predicate, direction, derived, status, ord
    closure: DataFrame | None = None  # ancestor, descendant, depth

    @property
    def names(self) -> DataFrame:
        return self.labels.select("s", F.col("label").alias("text"), F.lit(True).alias("is_label")).unionByName(self.aliases.select("s", F.col("alias").alias("text"), F.lit(False).alias("is_label")))

    @property
    def prop_values(self) -> DataFrame:
        """s, p, key: what a property filter compares, the linked entity's labels (or its id) for edges."""
        far = self.labels.select(F.col("s").alias("_s"), "label")
        linked = self.edges.join(far, F.col("o") == F.col("_s"), "left").select("s", "p", F.lower(F.coalesce("label", "o")).alias("key"))
        return self.facts.select("s", "p", F.lower("value").alias("key")).unionByName(linked)

    def with_closure(self, predicate: str = "contains") -> Graph:
        return replace(self, closure=transitive_closure(self.edges.where(F.col("p") == predicate).select("s", "o")))


def from_quads(spark: SparkSession, quads: DataFrame, type_dim: DataFrame, rel_dim: DataFrame) -> Graph:
    """Tables of a quad store: set semantics across documents."""
    t = quads.select("s", "p", "o", "o_kind").dropDuplicates()
    of = lambda p: t.where(F.col("p") == p)
    structural = ["type", "label", "alias", "mentionedIn", "hasMention", "inBook", "atPage", "title", "edition", "canonType"]
    rest = t.where(~F.col("p").isin(*[p for p in structural if p != "alias"]))
    books = of("title").select(F.col("s").alias("book"), F.col("o").alias("title"))
    for p, name in (("edition", "edition"), ("canonType", "canon_type")):
        books = books.join(of(p).select(F.col("s").alias("book"), F.col("o").alias(name)), "book", "left")
    at = of("atPage").select(F.col("s").alias("m"), F.col("o").alias("page"))
    mention = of("hasMention").select("s", F.col("o").alias("m")).join(of("inBook").select(F.col("s").alias("m"), F.col("o").alias("book")), "m").join(at, "m", "left").select("s", "book", "page")
    return Graph(
        of("label").select("s", F.col("o").alias("label")), of("alias").select("s", F.col("o").alias("alias")), of("type").select("s", F.col("o").alias("type")), rest.where("o_kind = 'iri'").select("s", "p", "o"),
        rest.where("o_kind = 'lit'").select("s", "p", F.col("o").alias("value")), mention, of("mentionedIn").select("s", F.col("o").alias("book")), books, type_dim, rel_dim,
    )


def transitive_closure(pairs: DataFrame) -> DataFrame:
    """ancestor, descendant, depth (least) over pairs (s, o), cycles included; pairs with a null end are passed over.

    The reach doubles in each round: a shortest path longer than it is one of just that length and another that is no longer. So rounds grow
    with the logarithm of the depth, and there is no bound on it.
    """
    found = cut(pairs.where("s is not null and o is not null").select(F.col("s").alias("ancestor"), F.col("o").alias("descendant"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while not (ends := found.where(F.col("depth") == reach)).isEmpty():
        on = found.select(F.col("ancestor").alias("_via"), F.col("descendant").alias("_to"), F.col("depth").alias("_more"))
        longer = ends.join(on, F.col("descendant") == F.col("_via")).select("ancestor", F.col("_to").alias("descendant"), (F.col("depth") + F.col("_more")).alias("depth"))
        found = cut(found.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        reach *= 2
    return found


# ---- filters -------------------------------------------------------------------------------------------------------------------------


def with_provenance(g: Graph, entities: DataFrame, edition: str | None = None, canon: str | None = None) -> DataFrame:
    """Entities that one book with this edition and this canon type mentions."""
    if edition is None and canon is None:
        return entities
    books = g.books
    for name, value in (("edition", edition), ("canon_type", canon)):
        books = books if value is None else books.where(F.col(name) == value)
    return entities.join(g.mentioned_in.join(books, "book").select("s").distinct(), "s", "left_semi")


def with_properties(g: Graph, entities: DataFrame, filters: dict[str, str] | None = None, match: str = "exact") -> DataFrame:
    """Entities that all filters hold for; a property of an entity's link compares the linked label."""
    values = g.prop_values
    for p, v in (filters or {}).items():
        key = F.lit(v.strip().lower())
        own = values.where((F.col("p") == p) & ((F.col("key") == key) if match == "exact" else F.contains("key", key)))
        entities = entities.join(own.select("s"), "s", "left_semi")
    return entities


def of_type(g: Graph, kind: str | None) -> DataFrame:
    rows = g.entity_types if kind is None else g.entity_types.where(F.col("type") == kind)
    return rows.select("s").distinct()


# ---- listing and search --------------------------------------------------------------------------------------------------------------


def list_names(g: Graph, kind: str, filters: dict[str, str] | None = None, edition: str | None = None, canon: str | None = None, match: str = "exact") -> DataFrame:
    """s, name of a type's entities; page it with `page`."""
    found = with_provenance(g, with_properties(g, of_type(g, kind), filters, match), edition, canon)
    return found.join(g.labels, "s").select("s", F.col("label").alias("name")).distinct()


def page(rows: DataFrame, limit: int, offset: int = 0, key: str = "name", tie: str = "s") -> DataFrame:
    return rows.orderBy(F.lower(key), key, tie).offset(offset).limit(limit)


def count_entities(g: Graph, kind: str, filters: dict[str, str] | None = None, edition: str | None = None, canon: str | None = None, match: str = "exact") -> DataFrame:
    """total: distinct entities, with or without a label."""
    return with_provenance(g, with_properties(g, of_type(g, kind), filters, match), edition, canon).agg(F.count("*").alias("total"))


def search_by_property(g: Graph, kind: str, prop: str, value: str, match: str = "exact", edition: str | None = None, canon: str | None = None) -> DataFrame:
    return list_names(g, kind, {prop: value}, edition, canon, match)


def search_entities(g: Graph, text: str, kind: str | None = None) -> DataFrame:
    """name, score (0 the whole name, 1 its beginning, 2 inside), hit (the text that matched best), types; a row for each label."""
    key = text.strip().lower()
    low = F.lower("text")
    score = F.when(low == key, 0).when(low.startswith(key), 1).otherwise(2)
    hits = g.names.where(F.contains(low, F.lit(key))).select("s", "text", score.alias("score"))
    if kind is not None:
        hits = hits.join(of_type(g, kind), "s", "left_semi")
    found = hits.join(g.labels, "s").join(g.entity_types, "s")
    return found.groupBy(F.col("label").alias("name")).agg(F.min("score").alias("score"), F.min_by("text", F.struct("score", "text")).alias("hit"), F.array_sort(F.collect_set("type")).alias("types"))


def by_relevance(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy("score", F.length("name"), F.lower("name"), "name").limit(limit)


#: Words that a question is searched without.
STOP_WORDS = frozenset("the and for with what who which where when how are was were is of in on to a an about tell me list from that this their there".split())


def words_of(question: str) -> list[str]:
    """A question's words of 3 letters or more, lower case, without stop words; repeated words count again."""
    import re

    return [w for w in re.findall(r"[\w'’-]+", question.lower()) if len(w) >= 3 and w not in STOP_WORDS]


def search_text(g: Graph, question: str, kind: str | None = None, described: DataFrame | None = None, width: int = 300, lead: int = 120) -> DataFrame:
    """s, name, score (how many of the words are in name and description), snippet around the first word."""
    words = words_of(question)
    text = described if described is not None else g.facts.where(F.col("p") == "description").select("s", F.col("value").alias("description"))
    if kind is not None:
        text = text.join(of_type(g, kind), "s", "left_semi")
    rows = text.join(g.labels, "s").select("s", F.col("label").alias("name"), "description", F.lower(F.concat_ws(" ", "label", "description")).alias("hay"))
    score = reduce(lambda a, b: a + b, [F.contains("hay", F.lit(w)).cast("int") for w in words], F.lit(0))
    scored = rows.withColumn("score", score).where("score > 0")
    best = scored.groupBy("s").agg(F.min_by(F.struct("name", "description", "score"), F.struct(-F.col("score"), -F.length("description"), F.col("name"), F.col("description"))).alias("b"))
    low = F.lower("b.description")
    at = F.array_min(F.filter(F.array(*[F.locate(w, low) for w in words]), lambda k: k > 0)) if words else F.lit(1)
    start = F.greatest(F.coalesce(at, F.lit(1)) - lead, F.lit(1))
    cut_off = F.substring(F.col("b.description"), start, F.lit(width))
    snippet = F.concat(F.when(start > 1, "…").otherwise(""), cut_off, F.when(start + width - 1 < F.length("b.description"), "…").otherwise(""))
    return best.select("s", "b.name", "b.score", snippet.alias("snippet"))


def by_score(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.desc(F.length("snippet")), "s").limit(limit)


# ---- one entity ----------------------------------------------------------------------------------------------------------------------


def resolve(g: Graph, name: str) -> DataFrame:
    """s, label, types, by_label of typed entities whose label or alias is the name; the label's own first, see `best_first`."""
    key = name.strip().lower()
    hits = g.names.where(F.lower("text") == key).select("s").distinct()
    found = hits.join(g.labels, "s").join(g.entity_types, "s")
    return found.groupBy("s", "label").agg(F.array_sort(F.collect_set("type")).alias("types")).withColumn("by_label", F.lower("label") == key)


def best_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("by_label"), F.lower("label"), "label", "s")


def entity_facts(g: Graph, entities: DataFrame) -> DataFrame:
    """s, p, values (sorted, distinct) of the entities in column s."""
    return g.facts.join(entities.select("s").distinct(), "s", "left_semi").groupBy("s", "p").agg(F.array_sort(F.collect_set("value")).alias("values"))


def _typed(g: Graph, ends: DataFrame, far: str) -> DataFrame:
    """ends with the far end's labels and types."""
    names = g.labels.select(F.col("s").alias("_n"), F.col("label").alias("other"))
    kinds = g.entity_types.select(F.col("s").alias("_t"), "type")
    return ends.join(names, F.col(far) == F.col("_n")).join(kinds, F.col(far) == F.col("_t"), "left")


def entity_edges(g: Graph, entities: DataFrame) -> DataFrame:
    """s, p, dir, other (label), types: links both ways; a loop shows once each way.

    The entities are distinct, so plain joins keep the same links as semi-joins, which would be repeated for each part of a union of edges.
    """
    own = entities.select("s").distinct()
    out = g.edges.join(own, "s").select("s", "p", F.lit("out").alias("dir"), F.col("o").alias("far"))
    back = g.edges.join(own.select(F.col("s").alias("o")), "o").select(F.col("o").alias("s"), "p", F.lit("in").alias("dir"), F.col("s").alias("far"))
    return _typed(g, out.unionByName(back), "far").groupBy("s", "p", "dir", "other").agg(F.array_sort(F.collect_set("type")).alias("types"))


def edge_names(g: Graph) -> DataFrame:
    """predicate, direction, api_name: the first relation of each."""
    return g.rel_dim.where("derived is null").groupBy("predicate", "direction").agg(F.min_by("name", "ord").alias("api_name"))


def grouped_edges(g: Graph, entities: DataFrame) -> DataFrame:
    """entity_edges by relation: its API name, or the predicate, with a note if it is read backwards."""
    named = edge_names(g).select(F.col("predicate").alias("p"), F.col("direction").alias("dir"), "api_name")
    label = F.coalesce("api_name", F.when(F.col("dir") == "out", F.col("p")).otherwise(F.concat("p", F.lit(" (inverse)"))))
    return entity_edges(g, entities).join(named, ["p", "dir"], "left").select("s", label.alias("relation"), "other", "types")


def relationship(g: Graph, predicate: str, direction: str = "out") -> DataFrame:
    """s, other (label), types for all entities at once; filter s for one."""
    near, far = ("s", "o") if direction == "out" else ("o", "s")
    ends = g.edges.where(F.col("p") == predicate).select(F.col(near).alias("s"), F.col(far).alias("far"))
    return _typed(g, ends, "far").groupBy("s", "other").agg(F.array_sort(F.collect_set("type")).alias("types"))


def relationship_total(g: Graph, predicate: str, direction: str = "out") -> DataFrame:
    """s, total: distinct labelled far ends, which can be more than names."""
    near, far = ("s", "o") if direction == "out" else ("o", "s")
    ends = g.edges.where(F.col("p") == predicate).select(F.col(near).alias("s"), F.col(far).alias("far"))
    return ends.join(g.labels.select(F.col("s").alias("far")).distinct(), "far", "left_semi").groupBy("s").agg(F.countDistinct("far").alias("total"))


def capitals(g: Graph, nation: str = "Nation") -> DataFrame:
    """entity, city, status: cities that say whose capital they are, and others with a status below an entity with no nation between."""
    status = g.facts.where("p = 'capitalStatus'").select(F.col("s").alias("city"), F.col("value").alias("status"))
    said = g.edges.where("p = 'capitalOf'").select(F.col("s").alias("city"), F.col("o").alias("entity"))
    first = said.join(status, "city", "left").select("entity", "city", F.coalesce("status", F.lit("current")).alias("status"))
    below = g.closure.select(F.col("ancestor").alias("entity"), F.col("descendant").alias("city"))
    second = status.join(said.select("city"), "city", "left_anti").join(below, "city")
    nations = of_type(g, nation).select(F.col("s").alias("mid"))
    upper = g.closure.select(F.col("ancestor").alias("entity"), F.col("descendant").alias("mid"))
    lower = g.closure.select(F.col("ancestor").alias("mid"), F.col("descendant").alias("city"))
    between = upper.join(nations, "mid", "left_semi").join(lower, "mid").select("entity", "city")
    return first.unionByName(second.join(between, ["entity", "city"], "left_anti").select("entity", "city", "status")).distinct()


def ancestors(g: Graph, predicate: str = "contains") -> DataFrame:
    """s, ancestor, depth for labelled ancestors: what lies above an unlabelled one counts only by another way."""
    steps = g.edges.where(F.col("p") == predicate).join(g.labels.select("s").distinct(), "s", "left_semi")
    return transitive_closure(steps.select("s", "o")).select(F.col("descendant").alias("s"), "ancestor", "depth")


def nearest_first(g: Graph, entity: str, predicate: str = "contains") -> DataFrame:
    """ancestor, depth of one entity over its labelled ancestors' own edges, as a breadth-first walk finds them."""
    start = F.lit(entity)
    near = g.labels.select("s").distinct()
    above = g.closure.where(F.col("descendant") == start).select(F.col("ancestor").alias("s")).join(near, "s", "left_semi")
    inside = above.union(above.sparkSession.range(1).select(start.alias("s"))).distinct()
    steps = induced_edges(g, inside, predicate)
    found = transitive_closure(steps.select("s", "o"))
    return found.where((F.col("descendant") == start) & (F.col("ancestor") != start)).select("ancestor", "depth").orderBy("depth", "ancestor")


def induced_edges(g: Graph, nodes: DataFrame, predicate: str = "contains") -> DataFrame:
    """s, o: links with both ends among the nodes (column s)."""
    own = nodes.select("s").distinct()
    return g.edges.where(F.col("p") == predicate).join(own, "s", "left_semi").join(own.select(F.col("s").alias("o")), "o").select("s", "o")


def children(g: Graph, depth: str = "direct") -> DataFrame:
    """s, other, types: what an entity contains, directly or at all levels."""
    if depth == "direct":
        return relationship(g, "contains")
    ends = g.closure.select(F.col("ancestor").alias("s"), F.col("descendant").alias("far"))
    return _typed(g, ends, "far").groupBy("s", "other").agg(F.array_sort(F.collect_set("type")).alias("types"))


def children_total(g: Graph, depth: str = "direct") -> DataFrame:
    """s, total: labelled entities that an entity contains, directly or at all levels; they can be more than their names."""
    if depth == "direct":
        return relationship_total(g, "contains")
    ends = g.closure.select(F.col("ancestor").alias("s"), F.col("descendant").alias("far"))
    return ends.join(g.labels.select(F.col("s").alias("far")).distinct(), "far", "left_semi").groupBy("s").agg(F.countDistinct("far").alias("total"))


def links_page(g: Graph, entities: DataFrame, page: int, size: int) -> DataFrame:
    """One page of grouped_edges by relation and name."""
    return grouped_edges(g, entities).orderBy("relation", "other", "s").offset(size * (page - 1)).limit(size)


def local_name(uri: Column, namespace: str) -> Column:
    """An IRI without the vocabulary's namespace; others, and null as an empty text, stay as they are."""
    whole = F.coalesce(uri, F.lit(""))
    return F.when(whole.startswith(namespace), F.substring(whole, len(namespace) + 1, 1 << 30)).otherwise(whole)


def reachable(g: Graph) -> bool:
    """Whether the store answers: one row is asked for."""
    try:
        g.labels.limit(1).collect()
    except Exception:  # noqa: BLE001
        return False
    return True


# ---- provenance and schema -----------------------------------------------------------------------------------------------------------


def sources(g: Graph) -> DataFrame:
    """s, title, edition, canon_type, pages (by number) of each entity's mentions."""
    rows = g.mentions.join(g.books, "book")
    return rows.groupBy("s", "title", "edition", "canon_type").agg(sorted_pages(F.collect_set("page")).alias("pages"))


def list_sources(g: Graph) -> DataFrame:
    return g.books.join(g.mentioned_in, "book", "left").groupBy("title", "edition", "canon_type").agg(F.countDistinct("s").alias("entities"))


def most_specific_types(g: Graph) -> DataFrame:
    """s, types without those that are above another of the same entity."""
    known = g.entity_types.join(F.broadcast(g.type_dim.select("type", "ancestors")), "type", "left")  # the vocabulary's size
    sets = known.groupBy("s").agg(F.collect_set("type").alias("t"), F.flatten(F.collect_set("ancestors")).alias("a"))
    return sets.select("s", F.array_sort(F.array_except("t", "a")).alias("types"))


def type_tree(g: Graph) -> DataFrame:
    return g.type_dim.where("parent is not null").groupBy("root").agg(F.array_sort(F.collect_list("type")).alias("types"))


def snippet_sources(g: Graph, hits: DataFrame, books: int = 3, pages: int = 3) -> DataFrame:
    """hits with up to three sources of up to three pages each, in one join for all hits."""
    one = F.struct("title", F.slice("pages", 1, pages).alias("pages"))
    found = sources(g).join(hits.select("s"), "s", "left_semi").groupBy("s").agg(F.slice(F.array_sort(F.collect_list(one)), 1, books).alias("sources"))
    return hits.join(found, "s", "left")
