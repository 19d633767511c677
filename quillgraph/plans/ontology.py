"""A vocabulary as data: types, relationships, fields and filterable properties, and the small tables made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KINDS = ("literal", "enum", "integer", "list", "out", "out_list", "in", "in_list", "both", "both_list")


@dataclass(frozen=True)
class Field:
    name: str
    predicate: str
    kind: str
    values: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")


@dataclass(frozen=True)
class Entity:
    """An extracted array: its key, root type, subtype selector (value -> type) and fields."""

    key: str
    root: str
    fields: tuple[Field, ...]
    selector: str | None = None
    subtypes: dict[str, str] = field(default_factory=dict)
    default: str | None = None
    #: relationship type -> (predicate, both ways)
    related: dict[str, tuple[str, bool]] = field(default_factory=dict)


@dataclass(frozen=True)
class Relation:
    name: str
    predicate: str | None
    direction: str
    derived: str | None = None
    status: str | None = None


@dataclass(frozen=True)
class Ontology:
    parents: dict[str, str | None]
    relations: tuple[Relation, ...]
    entities: tuple[Entity, ...]
    properties: dict[str, str] = field(default_factory=dict)
    version: str = "0.1.0"

    def ancestors(self, t: str) -> list[str]:
        """Nearest first; a cycle of parents ends at the first type that comes again."""
        out: list[str] = []
        while (t := self.parents.get(t) or "") and t not in out:
            out.append(t)
        return out

    def most_specific(self, types: list[str]) -> list[str]:
        above = {a for t in types for a in self.ancestors(t)}
        return sorted(t for t in set(types) if t not in above)

    def type_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(t, p, self.ancestors(t), (self.ancestors(t) or [t])[-1]) for t, p in self.parents.items()]
        return spark.createDataFrame(rows, "type string, parent string, ancestors array<string>, root string")

    def rel_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(r.name, r.predicate, r.direction, r.derived, r.status, k) for k, r in enumerate(self.relations)]
        return spark.createDataFrame(rows, "name string, predicate string, direction string, derived string, status string, ord int")

    def enum_values(self) -> dict[str, list[str]]:
        out: dict[str, set[str]] = {}
        for e in self.entities:
            for f in e.fields:
                if f.kind == "enum":
                    out.setdefault(f.predicate, set()).update(f.values)
        return {k: sorted(v) for k, v in sorted(out.items())}

    def type_tree(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {t: [] for t, p in self.parents.items() if p is None}
        for t in self.parents:
            if (a := self.ancestors(t)) and a[-1] in out:
                out[a[-1]].append(t)
        return {k: sorted(v) for k, v in sorted(out.items())}

    @classmethod
    def from_dict(cls, spec: dict) -> Ontology:
        """The same from nested dicts and lists, such as a YAML file holds."""
        entities = tuple(
            Entity(e["key"], e["root"], tuple(Field(f["name"], f["predicate"], f["kind"], tuple(f.get("values", ()))) for f in e.get("fields", ())), e.get("selector"), e.get("subtypes", {}), e.get("default"), {k: (v["predicate"], bool(v.get("both"))) for k, v in e.get("related", {}).items()})
            for e in spec.get("entities", ())
        )
        relations = tuple(Relation(r["name"], r.get("predicate"), r.get("direction", "out"), r.get("derived"), r.get("status")) for r in spec.get("relations", ()))
        return cls(dict(spec["types"]), relations, entities, dict(spec.get("properties", {})), str(spec.get("version", "0.1.0")))

    @classmethod
    def from_yaml(cls, path: str) -> Ontology:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f))


def at_least(first: str, second: str) -> bool:
    """Whether a semantic version is the second or a later one."""
    number = lambda v: tuple(int(x) for x in v.lstrip("v").split("-")[0].split("."))
    return number(first) >= number(second)
