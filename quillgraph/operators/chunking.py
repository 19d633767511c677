"""Markdown to chunks. Lines are classified by column expressions; what depends on a document's order of lines runs over one document at a time.

A null text has no lines, and a document without lines no sections and chunks; an empty table gives an empty one. Ids are the documents' own:
rows with one id are one document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import title_key
from ..session import partitions

CHUNKS = "doc_id string, chunk_idx int, sub_index int, text string, title string, page int, level int, token_count int, parent_index int, hierarchy array<string>"
TOC_LINE = r"^\s*(?:\|\s*)?(?:[-*+]\s+)?(?:\*\*)?(.+?)(?:\*\*)?\s*(?:\.{2,}|\s\|\s|\s{2,}|\t)[\s.|]*(\d{1,4})\s*\|?\s*$"
LEAST_TOKENS = 10
#: Characters of chunks that a worker gives in one batch, or one document's.
BATCH_CHARS = 4 << 20


def budget(context: int, overhead: int = 700) -> tuple[int, int]:
    """Least and most tokens of a chunk for a context window."""
    return max(10, context // 64), max(256, context * 3 // 4 - overhead)


def tokens(text: Column) -> Column:
    """An estimate: runs of letters and digits, and other characters but white space. Another counter can be given wherever this is used."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{White_Space}\p{L}\p{N}]".replace("White_Space", "IsWhite_Space"))).cast("int")


def count_tokens(text: str) -> int:
    """The same count of a Python text."""
    total, run = 0, False
    for c in text:
        kind = unicodedata.category(c)[0]
        word = kind in "LN"
        total += word and not run or not word and not c.isspace()
        run = word
    return total


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, line."""
    known = F.col(id_col) if docs.schema[id_col].dataType == T.StringType() else F.col(id_col).cast("string")  # a cast would hide how rows are dealt
    return docs.select(known.alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def front_matter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with meta (the text between leading --- lines, null if none) and body."""
    form = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    has = F.col(text_col).rlike(form)
    return docs.withColumn("meta", F.when(has, F.regexp_extract(text_col, form, 1))).withColumn("body", F.when(has, F.regexp_extract(text_col, form, 2)).otherwise(F.col(text_col)))


def is_prose(text: Column) -> Column:
    """Whether a line in bold or italics is a sentence and no heading."""
    return (F.size(F.split(F.trim(text), r"\s+")) > 12) | text.rlike(r"[.!?;,:]\s*$") | text.rlike(r"\.\s+\p{Lu}") | ~text.rlike(r"\p{L}{2}")


def classified(rows: DataFrame) -> DataFrame:
    """lines with kind (page, footer, heading, table, fence, blank, text), level (1-6 by marks, 7 bold, 8 italic) and title."""
    t = F.trim("line")
    marks = F.length(F.regexp_extract(t, r"^(#{1,6})\s+\S", 1))
    bold, italic = F.regexp_extract(t, r"^\*\*([^*]+)\*\*$", 1), F.regexp_extract(t, r"^[*_]([^*_]+)[*_]$", 1)
    marked = F.regexp_replace(F.regexp_replace(t, r"^#+\s+", ""), r"[*_]+", "")
    page = F.regexp_extract(t, r"^<!--\s*page:\s*(\d+)\s*-->$", 1)
    kind = (
        F.when(t == "", "blank").when(page != "", "page").when(t.startswith("|"), "table").when(t.startswith("```"), "fence")
        .when(t.rlike(r"^(?:\*\*\d{1,4}\*\*|\d{1,4})$") | t.rlike(r"(?i)^chapter\s+\w+\s*\|"), "footer")
        .when((marks > 0) & (F.length(F.trim(marked)) > 1), "heading").when((bold != "") & ~is_prose(bold), "heading").when((italic != "") & ~is_prose(italic), "heading").otherwise("text")
    )
    level = F.when(marks > 0, marks).when(bold != "", 7).when(italic != "", 8)
    title = F.trim(F.when(marks > 0, marked).when(bold != "", bold).otherwise(italic))
    heading = F.col("kind") == "heading"
    return rows.withColumn("kind", kind).withColumn("level", F.when(heading, level).cast("int")).withColumn("title", F.when(heading, title)).withColumn("page_mark", F.when(F.col("kind") == "page", page.cast("int")))


def sections(rows: DataFrame, token_count: Callable[[Column], Column] = tokens, least: int = LEAST_TOKENS) -> DataFrame:
    """doc_id, section, title, level, page (at the heading), text, token_count: gaps and islands over a document's lines.

    Text before the first heading is section 0. A text under `least` tokens goes with its heading; a heading without text stays.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("page", F.last("page_mark", ignorenulls=True).over(order)).withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(order))
    body = F.when(F.col("kind").isin("text", "table", "fence", "blank"), F.struct("line_no", "line"))
    found = rows.groupBy("doc_id", "section").agg(
        F.max("title").alias("title"), F.max("level").alias("level"), F.min_by("page", "line_no").alias("page"), F.trim(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]))).alias("text")
    )
    found = found.withColumn("text", F.regexp_replace("text", r"^\n+|\n+$", "")).withColumn("token_count", token_count(F.col("text")))
    return found.where((F.col("token_count") >= least) | ((F.col("text") == "") & F.col("title").isNotNull()))


def toc_entries(text_lines: list[str], search: int = 1000) -> tuple[list[tuple[str, int]], list[str]]:
    """Entries of a table of contents near the start, and the other lines. Three lines of its form in a row, blanks aside, begin it; the first
    two aren't entries; over five lines of another form in a row end it. What stands before and in it is no body."""
    entries, run, start, misses, end = [], 0, None, 0, None
    for i, line in enumerate(text_lines[:search]):
        if not line.strip():
            continue
        m = re.match(TOC_LINE, line)
        if start is None:
            run = run + 1 if m else 0
            if run >= 3:
                start = i
        if start is not None:
            if m:
                entries.append((re.sub(r"[*_]+", "", m[1]).strip(), int(m[2])))
                misses, end = 0, i
            else:
                misses += 1
                if misses > 5:
                    break
    return (entries, text_lines[end + 1 :]) if start is not None else ([], text_lines)


def toc_and_body(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The entries (doc_id, ord, title, start, chapter, key) of each document's table of contents, and the documents (doc_id, text) without it."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                found, rest = toc_entries((t or "").split("\n"))
                rows.append((d, "\n".join(rest), [(k, title, page) for k, (title, page) in enumerate(found)]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "toc"])

    cut_off = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id string, text string, toc array<struct<ord: int, title: string, start: int>>")
    entries = cut_off.select("doc_id", F.explode("toc").alias("e")).select("doc_id", "e.*")
    chapter = F.regexp_extract("title", r"(?i)\b(?:chapter|part)\s+(\d+)", 1).try_cast("int")
    return entries.select("*", chapter.alias("chapter"), title_key(F.col("title")).alias("key")), cut_off.select("doc_id", "text")


def with_toc(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Sections with toc_title: of the entry whose pages hold the section's, else of the first entry with the section's own title."""
    pages = found.where("page is not null").select("doc_id", "page").distinct()
    by_page = toc_of_page(pages, toc_ranges(entries))
    by_title = entries.groupBy("doc_id", "key").agg(F.min_by("title", "ord").alias("named"))
    both = found.join(by_page, ["doc_id", "page"], "left").withColumn("key", title_key(F.col("title"))).join(by_title, ["doc_id", "key"], "left")
    return both.select(*[found[c] for c in found.columns], F.coalesce("toc_title", "named").alias("toc_title"))


def toc_ranges(entries: DataFrame) -> DataFrame:
    """doc_id, title, start, end: an entry's pages, up to the next entry that starts later."""
    starts = entries.select("doc_id", "start").distinct()
    nxt = starts.withColumn("next", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))
    return entries.join(nxt, ["doc_id", "start"]).select("doc_id", "ord", "title", "start", (F.col("next") - 1).alias("end"))


def toc_of_page(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, page, toc_title: the range that starts last and holds the page, the first of equals."""
    r = ranges.select(F.col("doc_id").alias("_d"), "ord", "title", "start", "end")
    hit = pages.join(r, (pages.doc_id == F.col("_d")) & (F.col("page") >= F.col("start")) & (F.col("page") <= F.coalesce("end", F.lit(1 << 30))))
    return hit.groupBy("doc_id", "page").agg(F.max_by("title", F.struct("start", -F.col("ord"))).alias("toc_title"))


def with_hierarchy(items: list[dict]) -> list[dict]:
    """Sections in order, with the titles above each and the index of the nearest section of a lower level."""
    stack: list[tuple[int, int, str]] = []
    for i, s in enumerate(items):
        if s["level"] is not None:
            while stack and stack[-1][0] >= s["level"]:
                stack.pop()
        s["parent_index"] = stack[-1][1] if stack and s["level"] is not None else None
        s["hierarchy"] = [t for _, _, t in stack] + ([s["title"]] if s["title"] else [])
        if s["level"] is not None:
            stack.append((s["level"], i, s["title"]))
    return items


def merge_small(items: list[dict], least: int, most: int) -> list[dict]:
    """A section under `least` tokens joins the one before it where both fit into `most`; the titles stay out of the text."""
    out: list[dict] = []
    for s in items:
        if out and s["token_count"] < least and out[-1]["token_count"] + s["token_count"] <= most:
            out[-1] |= {"text": f"{out[-1]['text']}\n\n{s['text']}", "token_count": out[-1]["token_count"] + s["token_count"]}
        else:
            out.append(dict(s))
    return out


def split_large(s: dict, most: int, count: Callable[[str], int] = count_tokens) -> list[dict]:
    """A section over `most` tokens in parts at blank lines, a single paragraph over it by itself; sub_index only where there are several parts."""
    if s["token_count"] <= most:
        return [s | {"sub_index": None}]
    parts: list[tuple[list[str], int]] = []
    for p in s["text"].split("\n\n"):
        if not p.strip():
            continue
        n = count(p)
        if parts and parts[-1][1] + n <= most:
            parts[-1] = ([*parts[-1][0], p], parts[-1][1] + n)
        else:
            parts.append(([p], n))
    return [s | {"text": "\n\n".join(own), "token_count": n, "sub_index": k if len(parts) > 1 else None} for k, (own, n) in enumerate(parts)]


def chunks(found: DataFrame, context: int = 4096, overhead: int = 700, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of sections: hierarchy, small ones merged, large ones split. A document's sections are one row, as they are read in order; a worker
    takes rows by the batch and makes each document's chunks before the next one's."""
    least, most = budget(context, overhead)
    names = ("section", "title", "level", "page", "text", "token_count")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        fields = pa.schema(list(zip([c.split()[0] for c in CHUNKS.split(", ")], kinds, strict=True)))
        for batch in batches:
            out, held = [], 0
            for d, rows in zip(batch.column("doc_id"), batch.column("rows"), strict=True):
                made = [p for s in merge_small(with_hierarchy(rows.as_py()), least, most) for p in split_large(s, most, count)]
                out += [(d.as_py(), k, s["sub_index"], s["text"], s["title"], s["page"], s["level"], s["token_count"], s["parent_index"], s["hierarchy"]) for k, s in enumerate(made)]
                held += sum(len(s["text"] or "") for s in made)
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=fields)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=fields)

    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))
    return rows.mapInArrow(run, CHUNKS)


def manifest(labelled: DataFrame) -> DataFrame:
    """doc_id, chunks, entities, skipped of chunks with a label."""
    return labelled.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("label") == "ENTITIES").alias("entities"), F.count_if(F.col("label") != "ENTITIES").alias("skipped"))


#: Tags that end a line of a web page; Java's and RE2's patterns alike.
LINE_TAGS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|nav|article|section|main|aside|header|footer|table|tr|td|th|body|html|blockquote|pre)\b[^>]*>|</h[1-6]\s*>"
AWAY = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>", r"(?is)<!--.*?-->")


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """doc_id (the page), line_no, line: each web page's whole text as Markdown lines: its marker, headings with their marks, paragraphs between
    blank lines. A page is one document; a null page has no lines. Whole pages are dealt by id, so windows and groups of a document's lines need
    no other shuffle."""
    dealt = pages.where("html is not null and page_id is not null").select(F.col("page_id").cast("string").alias("doc_id"), "html").repartition(partitions(pages.sparkSession), "doc_id")
    text = F.col("html")
    for form in AWAY:
        text = F.regexp_replace(text, form, " ")
    text = F.regexp_replace(text, r"\s+", " ")
    for k in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{k}\b[^>]*>", "\n\n" + "#" * k + " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, LINE_TAGS, "\n\n"), r"<[^>]*>", ""), r" *\n\s*\n *", "\n\n")
    marked = F.concat(F.lit("<!-- page: "), F.col("doc_id"), F.lit(" -->\n\n"), F.btrim(text))
    return lines(dealt.select("doc_id", marked.alias("text")))
