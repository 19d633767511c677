"""The tool surface: requests to responses. Plans come from `graph`; only pages of rows reach the driver."""

from __future__ import annotations

import difflib
import json
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..plans.ontology import Ontology
from . import graph as G

CAP = 12_000
LONG_TEXT = 400
LINKS_PAGE = 60
WORKFLOW = ("describe_schema for types and properties", "list_names or search_by_property to enumerate", "search_entities for a name", "get_entity, get_relationships, get_location_hierarchy for one entity", "get_sources to cite")


def suggestions(name: str, known: list[str], most: int = 5) -> list[str]:
    near = difflib.get_close_matches(name, known, n=most, cutoff=0.5)
    low = name.lower()
    return [*near, *[k for k in known if k not in near and (low in k.lower() or k.lower() in low)]][:most]


def _inside(node):
    """The parts of a response, itself first."""
    yield node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _inside(child)


def _shortened(node, most: int):
    if isinstance(node, str):
        return node[:most] + "…" if len(node) > most else node
    if isinstance(node, dict):
        return {k: _shortened(v, most) for k, v in node.items()}
    return [_shortened(v, most) for v in node] if isinstance(node, list) else node


def capped(response: dict, cap: int = CAP) -> dict:
    """The response with its longest list, at whatever depth, halved until its JSON has `cap` characters at most; if no list is left to halve,
    texts are cut. What was cut is marked."""
    size = lambda x: len(json.dumps(x, ensure_ascii=False))
    if size(response) <= cap:
        return response
    while size(response) > cap and (lists := [x for x in _inside(response) if isinstance(x, list) and len(x) > 1]):
        longest = max(lists, key=size)
        del longest[len(longest) // 2 :]
    if size(response) > cap:
        response = _shortened(response, LONG_TEXT)
    return response | {"truncated": True, "note": "cut to fit; ask for a smaller page"}


def paged(rows: list, total: int, offset: int, key: str, cap: int = CAP, **more) -> dict:
    """One page: rows are trimmed first, so the next offset never passes over a row."""
    out = capped({"total": total, "offset": offset, key: rows, **more}, cap)
    out["count"] = len(out[key])
    if offset + out["count"] < total:
        out |= {"truncated": True, "next_offset": offset + out["count"], "hint": "ask again from next_offset"}
    return out


@dataclass
class Tools:
    graph: G.Graph
    onto: Ontology
    cap: int = CAP
    #: "serve" answers; in any other mode the store is being loaded and requests are put off.
    mode: str = "serve"

    def call(self, tool: str, **request) -> dict:
        """A request by the tool's name: an answer, or an error as a response."""
        if self.mode != "serve":
            return {"error": f"the store is in {self.mode} mode", "status": 503}
        if not G.reachable(self.graph):
            return {"error": "the store can't be reached", "status": 503}
        return getattr(self, tool)(**request)

    def describe_schema(self) -> dict:
        found = {"types": self.onto.type_tree(), "relationships": [r.name for r in self.onto.relations], "properties": sorted(self.onto.properties), "values": self.onto.enum_values()}
        return capped(found | {"workflow": WORKFLOW}, self.cap)

    def _short(self, what: str, text: str, least: int) -> dict | None:
        return None if len(text) >= least else {"error": f"{what} needs {least} characters or more", "hint": "give a longer text"}

    def _unknown(self, what: str, name: str, known) -> dict | None:
        return None if name in known else {"error": f"unknown {what}: {name}", "suggestions": suggestions(name, sorted(known))}

    def _page(self, rows, total: int, limit: int, offset: int, key: str = "names") -> dict:
        got = [r["name"] for r in G.page(rows, limit, offset).collect()]
        return paged(got, total, offset, key, self.cap)

    def list_names(self, kind: str, filters: dict | None = None, edition: str | None = None, canon: str | None = None, limit: int = 50, offset: int = 0, match: str = "exact") -> dict:
        if bad := self._unknown("type", kind, self.onto.parents):
            return bad
        for p in filters or {}:
            if self.onto.properties and (bad := self._unknown("property", p, self.onto.properties)):
                return bad
        total = G.count_entities(self.graph, kind, filters, edition, canon, match).first()["total"]
        return self._page(G.list_names(self.graph, kind, filters, edition, canon, match), total, max(1, min(limit, 200)), offset)

    def search_by_property(self, kind: str, prop: str, value: str, match: str = "exact", **page) -> dict:
        return self.list_names(kind, {prop: value}, match=match, **page)

    def search_entities(self, text: str, kind: str | None = None, limit: int = 10) -> dict:
        if bad := self._short("a name", text.strip(), 2) or (kind is not None and self._unknown("type", kind, self.onto.parents)):
            return bad
        return capped({"matches": self._search(text, kind, limit)}, self.cap)

    def _search(self, text: str, kind: str | None = None, limit: int = 10) -> list[dict]:
        rows = G.by_relevance(G.search_entities(self.graph, text, kind), max(1, min(limit, 50))).collect()
        return [{"name": r["name"], "types": self.onto.most_specific(r["types"])} | ({"matched_alias": r["hit"]} if r["hit"] != r["name"] else {}) for r in rows]

    def _resolve(self, name: str) -> list:
        return G.best_first(G.resolve(self.graph, name)).collect()

    def _no_entity(self, name: str) -> dict:
        found = [r["name"] for r in self._search(name, limit=5)]
        if not found and name.split():
            found = [r["name"] for r in self._search(max(name.split(), key=len), limit=5)]
        return {"error": f"unknown entity: {name}", "suggestions": found}

    def _one(self, uri: str):
        return self.graph.labels.where(F.col("s") == uri).select("s").limit(1)

    def get_entity(self, name: str, section: str = "facts", page: int = 1) -> dict:
        hits = self._resolve(name)
        if not hits:
            return self._no_entity(name)
        h = hits[0]
        out = {"name": h["label"], "types": self.onto.most_specific(h["types"])}
        if others := [x["label"] for x in hits[1:]]:
            out["other_matches"] = others
        if section == "facts":
            rows = G.entity_facts(self.graph, self._one(h["s"])).orderBy("p").collect()
            return capped(out | {"facts": {r["p"]: r["values"][0] if len(r["values"]) == 1 else r["values"] for r in rows}}, self.cap)
        links = G.links_page(self.graph, self._one(h["s"]), page, LINKS_PAGE).collect()
        total = G.grouped_edges(self.graph, self._one(h["s"])).count()
        grouped: dict[str, list] = {}
        for r in links:
            grouped.setdefault(r["relation"], []).append({"name": r["other"], "types": self.onto.most_specific(r["types"])})
        out |= {"page": page, "total_links": total, "relationships": grouped}
        if LINKS_PAGE * page < total:
            out |= {"truncated": True, "hint": f"ask again for page {page + 1}"}
        return capped(out, self.cap)

    def get_relationships(self, name: str, relation: str, limit: int = 50, offset: int = 0) -> dict:
        spec = next((r for r in self.onto.relations if r.name == relation), None)
        if spec is None:
            return self._unknown("relationship", relation, {r.name for r in self.onto.relations})
        hits = self._resolve(name)
        if not hits:
            return self._no_entity(name)
        uri = F.col("s") == hits[0]["s"]
        if spec.derived == "capital":
            found = G.capitals(self.graph).where((F.col("entity") == hits[0]["s"]) & (F.col("status") == spec.status)).select(F.col("city").alias("s"))
            rows = found.join(self.graph.labels, "s").select("s", F.col("label").alias("name")).distinct()
            return self._page(rows, rows.select("s").distinct().count(), limit, offset)
        total = G.relationship_total(self.graph, spec.predicate, spec.direction).where(uri).first()
        rows = G.relationship(self.graph, spec.predicate, spec.direction).where(uri).select("s", F.col("other").alias("name"))
        return self._page(rows, total["total"] if total else 0, limit, offset)

    def get_location_hierarchy(self, name: str, depth: str = "direct", limit: int = 50, offset: int = 0) -> dict:
        hits = self._resolve(name)
        if not hits:
            return self._no_entity(name)
        uri = hits[0]["s"]
        names = self.graph.labels.groupBy("s").agg(F.min("label").alias("label"))
        above = G.nearest_first(self.graph, uri).join(names, F.col("ancestor") == F.col("s")).orderBy("depth", "ancestor").collect()
        rows = G.children(self.graph, depth).where(F.col("s") == uri).select("s", F.col("other").alias("name"))
        total = G.children_total(self.graph, depth).where(F.col("s") == uri).first()
        return {"location": hits[0]["label"], "ancestors": [r["label"] for r in above]} | self._page(rows, total["total"] if total else 0, limit, offset, "children")

    def get_sources(self, names: list[str], edition: str | None = None, canon: str | None = None) -> dict:
        out = []
        for n in names[:10]:
            hits = self._resolve(n)
            if not hits:
                out.append(self._no_entity(n))
                continue
            rows = G.sources(self.graph).where(F.col("s") == hits[0]["s"])
            rows = rows if edition is None else rows.where(F.col("edition") == edition)
            rows = rows if canon is None else rows.where(F.col("canon_type") == canon)
            out.append({"name": hits[0]["label"], "sources": [{k: r[k] for k in ("title", "edition", "canon_type", "pages")} for r in rows.orderBy("title").collect()]})
        return capped({"entities": out}, self.cap)

    def search_text(self, question: str, kind: str | None = None, limit: int = 10) -> dict:
        if bad := self._short("a question", question, 3) or (kind is not None and self._unknown("type", kind, self.onto.parents)):
            return bad
        if not G.words_of(question):
            return {"error": f"no words to search for in {question!r}", "hint": "use a word of 3 letters or more that isn't a stop word"}
        hits = G.by_score(G.search_text(self.graph, question, kind), max(1, min(limit, 25)))
        rows = G.snippet_sources(self.graph, hits).orderBy(F.desc("score"), F.desc(F.length("snippet")), "s").collect()
        cited = lambda b: b["title"] + (f" p.{', '.join(p)}" if (p := [x for x in b["pages"] if x]) else "")
        return capped({"matches": [{"name": r["name"], "matched_words": r["score"], "snippet": r["snippet"], "sources": list(map(cited, r["sources"] or []))} for r in rows]}, self.cap)

    def list_sources(self) -> dict:
        return capped({"sources": [r.asDict() for r in G.list_sources(self.graph).orderBy("title").collect()]}, self.cap)
