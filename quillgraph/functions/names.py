"""Column expressions on names, years, pages and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing name.
PLACEHOLDERS = ("null", "none", "n/a", "unknown", "unnamed", "name", "entity name")
#: Unicode classes: Java's \w, \s and \d are ASCII without the flag.
UNICODE = "(?U)"


def clean_name(name: Column) -> Column:
    """The trimmed name; null if it is blank or a placeholder."""
    n = F.trim(name)
    return F.when((n != "") & ~F.lower(n).isin(*PLACEHOLDERS), n)


def slug(name: Column) -> Column:
    """Identity of an entity: no punctuation, runs of spaces and hyphens as one underscore."""
    kept = F.trim(F.regexp_replace(name, UNICODE + r"[^\w\s-]", ""))
    return F.regexp_replace(kept, UNICODE + r"[\s-]+", "_")


def year(value: Column) -> Column:
    """The first integer of a year's text, thousands commas dropped; null for booleans, durations ("ago") and texts without one."""
    v = F.regexp_replace(value.cast("string"), ",", "")
    ok = ~F.lower(v).isin("true", "false") & ~F.lower(v).contains("ago")
    return F.when(ok, F.nullif(F.regexp_extract(v, r"-?\d+", 0), F.lit("")).try_cast("bigint"))


def page_number(page: Column) -> Column:
    return F.nullif(F.regexp_extract(page, r"\d+", 0), F.lit("")).try_cast("bigint")


def sorted_pages(pages: Column) -> Column:
    """Distinct pages by their first number; those without one last, then by text."""
    keyed = F.transform(F.array_distinct(pages), lambda p: F.struct(page_number(p).isNull().alias("none"), page_number(p).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def path_id(path: Column) -> Column:
    """A document's id from its relative path."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def path_title(stem: Column) -> Column:
    return F.trim(F.initcap(F.regexp_replace(stem, r"[^\p{L}\p{N}]", " ")))


def path_parts(path: Column, editions: list[str], canons: list[str]) -> Column:
    """edition, canon_type (the first folder that names one) and tags (all other folders) of a relative path."""
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x != "")
    low = lambda x: F.lower(x)
    edition = F.get(F.filter(folders, lambda x: low(x).isin(*editions)), F.lit(0))
    canon = F.get(F.filter(folders, lambda x: low(x).isin(*canons)), F.lit(0))
    tags = F.array_distinct(F.filter(folders, lambda x: ~low(x).isin(*editions, *canons)))
    return F.struct(low(edition).alias("edition"), low(canon).alias("canon_type"), tags.alias("tags"))


def merged_tags(path_tags: Column, own_tags: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(path_tags, none), F.coalesce(own_tags, none)))


def file_slug(title: Column) -> Column:
    """Part of a debug file's name: 40 characters at most."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "_"), 1, 40), "^_+|_+$", "")


def title_key(title: Column) -> Column:
    """A heading for comparison: lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), UNICODE + r"[^\w\s]", ""), r"\s+", " "))
