"""Extracted objects to quads, by a vocabulary's field map.

Input rows: doc_id, chunk_idx, page (the chunk's), book, body (a JSON object of arrays, one for each entity key), ord (arrival).
Everything is a projection of one array of entities; the type fold shuffles, by slug and with types reduced first, and quads that may come twice. A null or broken body,
and objects without a usable name, give nothing; null ids and books are kept; a quad that comes twice in a document counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name, slug, year
from ..plans.ontology import Entity, Field, Ontology
from ..sources.store import QUADS, cut

#: Stands for the page of a mention without one.
NO_PAGE = "nopage"


def _text(v: str, name: str) -> Column:
    """A field as text: scalars as they are, null if absent."""
    return F.expr(f"try_variant_get({v}, '$.{name}', 'string')")


def _items(v: str, name: str) -> Column:
    """A list field's texts; a scalar is a list of one, null or absent is empty."""
    many = F.expr(f"try_variant_get({v}, '$.{name}', 'array<string>')")
    return F.coalesce(many, F.filter(F.array(_text(v, name)), lambda x: x.isNotNull()))


def entities(extracted: DataFrame, onto: Ontology) -> DataFrame:
    """doc_id, chunk_idx, ord, pos, key, book, pages, name, slug, class, v (the object): one row for each named object.

    A reply is parsed once, whatever the number of keys: the objects of all keys are one array.
    """
    parsed = extracted.withColumn("_j", F.expr("try_parse_json(body)"))
    tagged = lambda k: lambda v, pos: F.struct(F.lit(k).alias("k"), pos.alias("pos"), v.alias("v"))
    listed = [F.transform(F.expr(f"try_variant_get(_j, '$.{e.key}', 'array<variant>')"), tagged(k)) for k, e in enumerate(onto.entities)]
    rows = parsed.select("doc_id", "chunk_idx", "ord", "page", "book", F.explode(F.flatten(F.filter(F.array(*listed), lambda x: x.isNotNull()))).alias("_x")).select("*", "_x.*")
    pages, single = F.filter(_items("v", "page_references"), lambda x: F.trim(x) != ""), F.nullif(F.trim(_text("v", "page_reference")), F.lit(""))
    pages = F.when(F.size(pages) > 0, pages).otherwise(F.filter(F.array(F.coalesce(single, F.col("page").cast("string"))), lambda x: x.isNotNull()))
    of_key = lambda f: reduce(lambda c, ke: c.when(F.col("k") == ke[0], f(ke[1])), list(enumerate(onto.entities))[1:], F.when(F.col("k") == 0, f(onto.entities[0])))
    own = rows.select(
        "doc_id", "chunk_idx", (F.col("ord") * len(onto.entities) + F.col("k")).alias("ord"), "pos", of_key(lambda e: F.lit(e.key)).alias("key"), "book",
        pages.alias("pages"), clean_name(_text("v", "name")).alias("name"), of_key(resolve_class).alias("class"), "v",
    )
    return own.where("name is not null").withColumn("slug", slug(F.col("name"))).where("slug <> ''")


def resolve_class(e: Entity, v: str = "v") -> Column:
    """The type that an object's selector field names, in any case; else the entity's default or root."""
    none = F.lit(e.default or e.root)
    if not e.selector:
        return none
    key = F.lower(F.trim(_text(v, e.selector)))
    chosen = reduce(lambda c, kv: c.when(key == kv[0].lower(), kv[1]), list(e.subtypes.items())[1:], F.when(key == next(iter(e.subtypes)).lower(), next(iter(e.subtypes.values()))))
    return chosen.otherwise(none)


def type_fold(found: DataFrame, onto: Ontology, order: tuple[str, ...] = ("ord", "chunk_idx", "pos")) -> DataFrame:
    """slug, class, conflicts: types of one slug folded in order of arrival.

    A narrower type replaces a wider one, a wider one changes nothing, an unrelated one is kept out and noted as (class so far, refused).
    Only the first arrival of each (slug, class) matters, so that is all that is gathered: at most the vocabulary's size for each slug.
    """
    first = found.groupBy("slug", "class").agg(F.min(F.struct(*order)).alias("at"))
    above = F.create_map(*[F.lit(x) for t in onto.parents for x in (t, "|".join(["", *onto.ancestors(t), ""]))])
    is_above = lambda a, of: F.contains(F.coalesce(above[of], F.lit("")), F.concat(F.lit("|"), a, F.lit("|")))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("at", "class"))), lambda x: x["class"])
    none = F.array().cast("array<struct<existing:string,refused:string>>")

    def step(acc: Column, t: Column) -> Column:
        now, bad = acc["class"], acc["bad"]
        keep = F.struct(now.alias("class"), bad.alias("bad"))
        return (
            F.when(now.isNull() | is_above(now, t), F.struct(t.alias("class"), bad.alias("bad")))
            .when((now == t) | is_above(t, now), keep)
            .otherwise(F.struct(now.alias("class"), F.array_append(bad, F.struct(now.alias("existing"), t.alias("refused"))).alias("bad")))
        )

    fold = F.aggregate("seq", F.struct(F.lit(None).cast("string").alias("class"), none.alias("bad")), step)
    return first.groupBy("slug").agg(seq.alias("seq")).select("slug", fold.alias("f")).select("slug", F.col("f.class").alias("class"), F.array_distinct("f.bad").alias("conflicts"))


def type_conflicts(folded: DataFrame) -> DataFrame:
    return folded.select("slug", F.explode("conflicts").alias("c")).select("slug", "c.existing", "c.refused").distinct().orderBy("slug", "existing", "refused")


def _all(p: str) -> bool:
    return True


def with_values(found: DataFrame, of: tuple[Entity, ...], keep: Callable[[str], bool] = _all) -> DataFrame:
    """Objects with what field_parts reads of them as columns, so each field is read and cleaned once: `_one_`, `_many_`, `_ends_` and its name,
    and `_links`, the relationships with their slugs.

    A field is read of objects whose key has it, and null of the others; only fields whose predicate is kept are read.
    """
    one, many, ends = {}, {"aliases": [e.key for e in of]} if keep("alias") else {}, {}
    for e in of:
        for f in e.fields:
            if keep(f.predicate):
                (many if _listed(f) else one).setdefault(f.name, []).append(e.key)
                if _way(f):
                    ends[f.name] = _listed(f)
    has = lambda keys: F.col("key").isin(*keys)
    distinct = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))
    read = found.withColumns({f"_raw_{n}": F.when(has(keys), _text("v", n)) for n, keys in one.items()})
    read = read.withColumns({
        **{f"_one_{n}": clean_name(F.col(f"_raw_{n}")) for n in one},
        **{f"_many_{n}": distinct(F.transform(F.when(has(keys), _items("v", n)), clean_name)) for n, keys in many.items()},
    })
    if any(keep(p) for e in of for p, _ in e.related.values()):
        links = F.expr("try_variant_get(v, '$.relationships', 'array<struct<target:string,type:string>>')")
        kind = lambda r: F.lower(F.trim(F.coalesce(r["type"], F.lit("other"))))
        slugs = F.transform(links, lambda r: F.struct(kind(r).alias("kind"), slug(clean_name(r["target"])).alias("end")))
        read = read.withColumn("_links", F.when(has([e.key for e in of if e.related]), F.filter(slugs, lambda r: r["end"].isNotNull() & (r["end"] != ""))))
    return read.withColumns({f"_ends_{n}": distinct(F.transform(f"_many_{n}", slug) if listed else F.array(slug(F.col(f"_one_{n}")))) for n, listed in ends.items()})


def _listed(f: Field) -> bool:
    return f.kind == "list" or f.kind.endswith("_list")


def _way(f: Field) -> str:
    """out, in or both; empty for fields that are no links."""
    way = f.kind.removesuffix("_list")
    return way if way in ("out", "in", "both") else ""


def crossing(onto: Ontology) -> set[str]:
    """Predicates that objects write both from and to themselves: only their quads can come from two entities of one document."""
    out, into = {"type", "label", "alias", "mentionedIn", "hasMention", "inBook", "atPage"}, set()
    for e in onto.entities:
        for f in e.fields:
            if _way(f) != "in":
                out.add(f.predicate)
            if _way(f) in ("in", "both"):
                into.add(f.predicate)
        out |= {p for p, _ in e.related.values()}
        into |= {p for p, both in e.related.values() if both}
    return out & into


def _row(s: Column, p: str, o: Column, kind: str, datatype: str | None) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"))


def field_parts(e: Entity, keep: Callable[[str], bool] = _all) -> list[tuple[str, Column]]:
    """Predicates and arrays of triples of an object's fields, from the columns of with_values; some triples have a null or empty object. No array
    holds a triple twice."""
    me = F.col("slug")
    # these take the field first: a lambda of two parameters would get the place in the array as its second
    value_rows = lambda p: lambda x: _row(me, p, x, "lit", "string")
    out_rows = lambda p: lambda x: _row(me, p, x, "iri", None)
    in_rows = lambda p: lambda x: _row(x, p, me, "iri", None)
    of_kind = lambda k: lambda r: r["kind"] == k
    parts = []
    for f in e.fields:
        if not keep(f.predicate):
            continue
        text, value, each, ends, way = F.col(f"_raw_{f.name}"), F.col(f"_one_{f.name}"), F.col(f"_many_{f.name}"), F.col(f"_ends_{f.name}"), _way(f)
        if f.kind == "literal":
            parts.append((f.predicate, F.array(_row(me, f.predicate, value, "lit", "string"))))
        elif f.kind == "enum":
            parts.append((f.predicate, F.array(_row(me, f.predicate, F.when(F.lower(F.trim(text)).isin(*f.values), F.lower(F.trim(text))), "lit", "string"))))
        elif f.kind == "integer":
            parts.append((f.predicate, F.array(_row(me, f.predicate, year(text).cast("string"), "lit", "integer"))))
        elif f.kind == "list":
            parts.append((f.predicate, F.transform(each, value_rows(f.predicate))))
        if way in ("out", "both"):
            parts.append((f.predicate, F.transform(ends, out_rows(f.predicate))))
        if way in ("in", "both"):
            parts.append((f.predicate, F.transform(ends, in_rows(f.predicate))))
    for kind, (p, both) in e.related.items():
        if keep(p):
            ends = F.array_distinct(F.transform(F.filter("_links", of_kind(kind)), lambda r: r["end"]))
            parts += [(p, F.transform(ends, rows(p))) for rows in ((out_rows, in_rows) if both else (out_rows,))]
    if keep("alias"):
        parts.append(("alias", F.transform(F.filter("_many_aliases", lambda x: x != F.col("name")), value_rows("alias"))))
    return parts


def _distinct(parts: list[tuple[str, Column]]) -> Column:
    """One array of all parts' triples, each once: triples can only be equal where several parts have their predicate."""
    by: dict[str, list[Column]] = {}
    none = F.array().cast("array<struct<s:string,p:string,o:string,o_kind:string,datatype:string>>")
    for p, rows in parts:
        by.setdefault(p, []).append(F.coalesce(rows, none))
    return F.concat(none, *[rows[0] if len(rows) == 1 else F.array_distinct(F.concat(*rows)) for rows in by.values()])


def field_array(e: Entity, keep: Callable[[str], bool] = _all) -> Column:
    """All triples of an object's fields as one array, from the columns of with_values; some have a null or empty object. Each comes once."""
    return _distinct(field_parts(e, keep))


def _own(found: DataFrame, onto: Ontology, keep: Callable[[str], bool], held: tuple[str, ...] = ("doc_id", "slug")) -> DataFrame:
    """The columns held and t, the quads that an object itself gives (all but its types), each once for an object."""
    me, book = F.col("slug"), F.col("book")
    node = lambda page: F.concat_ws("/", F.lit("mention"), me, book, slug(page))
    rows, common = with_values(found, onto.entities, keep), []
    if keep("label"):
        common.append(("label", F.array(_row(me, "label", F.col("name"), "lit", "string"))))
    if keep("mentionedIn"):
        common.append(("mentionedIn", F.array(_row(me, "mentionedIn", book, "iri", None))))
    if keep("hasMention") or keep("inBook") or keep("atPage"):
        pages = F.when(F.size("pages") > 0, F.array_distinct("pages")).otherwise(F.array(F.lit(NO_PAGE)))
        rows = rows.withColumn("_nodes", F.transform(pages, lambda p: F.struct(p.alias("page"), node(p).alias("node"))))
        nodes = F.array_distinct("_nodes.node")
        seen = {
            "hasMention": F.transform(nodes, lambda n: _row(me, "hasMention", n, "iri", None)), "inBook": F.transform(nodes, lambda n: _row(n, "inBook", book, "iri", None)),
            "atPage": F.transform("_nodes", lambda x: _row(x["node"], "atPage", F.when(x["page"] != NO_PAGE, x["page"]), "lit", "string")),
        }
        common += [(p, c) for p, c in seen.items() if keep(p)]
    own = [(e.key, _distinct([*common, *field_parts(e, keep)])) for e in onto.entities]
    return rows.select(*held, F.coalesce(*[F.when(F.col("key") == k, c) for k, c in own]).alias("t"))


def _said(rows: DataFrame) -> DataFrame:
    # of explode the optimizer would infer a filter on t and make t once more for it
    return rows.select("doc_id", F.explode_outer("t").alias("t")).select("doc_id", "t.*").where("o is not null and o <> ''")


#: Entities of several objects in a document that are broadcast at most; more are joined by a shuffle.
SMALL = 1_000_000


def quads(extracted: DataFrame, onto: Ontology, keep: Callable[[str], bool] = _all, keys: tuple[str, ...] = ()) -> DataFrame:
    """All quads of extracted chunks: types with their ancestors by the fold over all documents, names, mentions and fields.

    keep: the predicates that are wanted; what the others need is neither read nor made. keys: the entity keys that are wanted, all if empty.

    A quad is at home with the entity that gives it, by document and slug. So quads are compared only where an entity has several objects in a
    document, and of predicates that go both ways (crossing); all others come once by themselves and are not shuffled.
    """
    found = entities(extracted, onto)
    found = found.where(F.col("key").isin(*keys)) if keys else found
    fields = {f.predicate for e in onto.entities for f in e.fields} | {p for e in onto.entities for p, _ in e.related.values()}
    wanted = {p for p in {*fields, "label", "alias", "mentionedIn", "hasMention", "inBook", "atPage"} if keep(p)}
    both = crossing(onto) & wanted
    plain = 2 * len(both) >= len(wanted)  # few others: reading the replies again would be dearer than comparing theirs too
    held = ("doc_id", "slug", *(("class", "ord", "chunk_idx", "pos") if keep("type") else ()))
    parts = []
    if keep("type") or not plain:
        arrived = cut(found.select(*held) if plain or not both else _own(found, onto, both.__contains__, held))
    if keep("type"):
        folded = type_fold(arrived, onto).select("slug", "class")
        dim = F.broadcast(onto.type_dim(extracted.sparkSession).select(F.col("type").alias("class"), F.array_distinct(F.concat(F.array("type"), "ancestors")).alias("all")))  # the vocabulary's size
        typed = arrived.select("doc_id", "slug").distinct().join(folded, "slug").join(dim, "class", "left")
        typed = typed.select("doc_id", F.col("slug").alias("s"), F.lit("type").alias("p"), F.explode(F.coalesce("all", F.array("class"))).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
        parts.append(typed.where("o <> ''"))  # p is a literal, so whoever filters by another predicate has no such branch in the plan
    if plain and wanted:
        parts.append(_said(_own(found, onto, wanted.__contains__)).dropDuplicates())
    if not plain:
        home, once = (wanted - both).__contains__, found
        several = cut(arrived.groupBy("doc_id", "slug").count().where("count > 1").select(F.col("doc_id").alias("_doc"), F.col("slug").alias("_slug")))
        if n := several.count():
            side = F.broadcast(several) if n <= SMALL else several
            same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("slug") == F.col("_slug"))
            parts.append(_said(_own(found.join(side, same, "left_semi"), onto, home)).dropDuplicates())
            once = found.join(side, same, "left_anti")
        own = _said(_own(once, onto, home))
        parts.append(own.withColumn("p", F.lit(next(iter(wanted - both)))) if len(wanted - both) == 1 else own)
        if both:
            parts.append(_said(arrived).dropDuplicates())
    if not parts:
        return extracted.sparkSession.createDataFrame([], QUADS)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.dropDuplicates() if keep("type") and "type" in fields else rows


def book_quads(books: DataFrame) -> DataFrame:
    """doc_id, s, p, o ... of source books (doc_id, book, title, edition, canon_type and maybe publisher, publication_year)."""
    names = [(c, p) for c, p in (("title", "title"), ("edition", "edition"), ("canon_type", "canonType"), ("publisher", "publisher"), ("publication_year", "publicationYear")) if c in books.columns]
    rows = F.array(*[F.struct(F.col("book").alias("s"), F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit("lit").alias("o_kind"), F.lit("integer" if c == "publication_year" else "string").alias("datatype")) for c, p in names])
    return books.select("doc_id", F.explode(rows).alias("t")).select("doc_id", "t.*").where("o is not null").dropDuplicates()


def counts(rows: DataFrame) -> DataFrame:
    """doc_id, subjects (all), entities (labelled ones), triples."""
    of_subject = rows.groupBy("doc_id", "s").agg(F.max(F.coalesce(F.col("p") == "label", F.lit(False))).alias("labelled"), F.count("*").alias("n"))
    return of_subject.groupBy("doc_id").agg(F.count("s").alias("subjects"), F.count_if("labelled").alias("entities"), F.sum("n").alias("triples"))
