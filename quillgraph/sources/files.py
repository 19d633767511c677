"""Documents from folders: scan, sidecars, submission checks, re-ingestion and Markdown pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N

EDITIONS = ["1e", "2e", "3e", "3.5e", "4e", "5e", "any"]
CANONS = ["canon", "kanon", "fanon", "any"]
REQUIRED = ("document_id", "title", "edition", "canon_type")
MIN_WORDS = 50


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length of each file below a folder; contents are read only if they are selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def registered(files: DataFrame, root: str) -> DataFrame:
    """Files with the id, title, edition, canon type and tags that their place says."""
    base = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.element_at(F.split("path", "\\Q" + base + "\\E"), -1)
    stem = F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"\.[^.]*$", "")
    parts = N.path_parts(rel, EDITIONS, CANONS)
    return files.select("path", "modificationTime", N.path_id(F.regexp_replace(rel, r"\.[^.]*$", "")).alias("document_id"), N.path_title(stem).alias("title"), parts["edition"].alias("edition"), parts["canon_type"].alias("canon_type"), parts["tags"].alias("tags"))


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """sidecars: document_id and any of title, edition, canon_type, tags; what they say goes before what the path says."""
    own = [c for c in ("title", "edition", "canon_type") if c in sidecars.columns]
    other = sidecars.select("document_id", *[F.col(c).alias(f"_{c}") for c in own], *([F.col("tags").alias("_tags")] if "tags" in sidecars.columns else []))
    joined = files.join(other, "document_id", "left")
    out = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in own})
    if "tags" in sidecars.columns:
        out = out.withColumn("tags", N.merged_tags(F.col("tags"), F.col("_tags")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """document_id and value (a YAML text) to a map of its top-level entries as text; a broken text gives an empty map."""
    @F.pandas_udf("map<string,string>")
    def parsed(col: pd.Series) -> pd.Series:
        import yaml

        def one(text):
            try:
                found = yaml.safe_load(text or "")
            except yaml.YAMLError:
                return {}
            return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}

        return col.map(one)

    return texts.select("document_id", parsed("value").alias("fields"))


def to_ingest(files: DataFrame, state: DataFrame) -> DataFrame:
    """Unknown files, and completed ones that changed since."""
    done = state.select("document_id", "ingestion_completed_at")
    known = files.join(done.withColumn("_known", F.lit(True)), "document_id", "left")
    return known.where(F.col("_known").isNull() | (F.col("ingestion_completed_at").isNotNull() & (F.col("modificationTime") > F.col("ingestion_completed_at")))).drop("_known", "ingestion_completed_at")


def submission_error(edition: Column, canon: Column) -> Column:
    missing = F.concat_ws(", ", *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED])
    return F.when(missing != "", F.concat(F.lit("missing: "), missing)).when(~edition.isin(*EDITIONS), F.lit("unknown edition")).when(~canon.isin(*CANONS), F.lit("unknown canon type"))


def submitted(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests with an error (null if accepted): missing fields, unknown values, or an id that is known already."""
    known = state.select(F.col("document_id").alias("_k")).distinct()
    out = requests.join(known, requests.document_id == F.col("_k"), "left")
    return out.withColumn("error", F.coalesce(submission_error(F.col("edition"), F.col("canon_type")), F.when(F.col("_k").isNotNull(), F.lit("already submitted")))).drop("_k")


def pages_of(doc_id: str, content: bytes | None, opened) -> list[tuple[str, int, str]]:
    """doc_id, page_no, markdown of one PDF; `opened` makes a sequence of pages of its bytes. A page that can't be read has a note instead, and a
    file that can't be opened is one page with a note: neither fails the others' job."""
    try:
        pdf = opened(bytes(content or b""))
    except Exception as e:  # noqa: BLE001
        return [(doc_id, 1, f"[file could not be opened: {type(e).__name__}]")]
    rows = []
    with pdf:
        for k in range(len(pdf)):
            try:
                rows.append((doc_id, k + 1, pdf[k].get_text()))
            except Exception:  # noqa: BLE001
                rows.append((doc_id, k + 1, f"[page {k + 1} could not be read]"))
    return rows


def converted(files: DataFrame) -> DataFrame:
    """doc_id, page_no, markdown of PDF files, if a PDF library is installed; see pages_of for what can't be read."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF; give pages as Markdown instead") from e

    def run(batches):
        import fitz

        for batch in batches:
            rows = [r for d, c in zip(batch["document_id"], batch["content"], strict=True) for r in pages_of(d, c, lambda data: fitz.open(stream=data, filetype="pdf"))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "markdown"])

    return files.select("document_id", "content").mapInPandas(run, "doc_id string, page_no int, markdown string")


def needs_ocr(pages: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, words_per_page, needs_ocr."""
    words = F.size(F.filter(F.split("markdown", r"\s+"), lambda w: w != ""))
    return pages.groupBy("doc_id").agg(F.avg(words).alias("words_per_page")).withColumn("needs_ocr", F.col("words_per_page") < least)


def page_marked(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: pages in order, each after its marker."""
    one = F.struct("page_no", F.concat(F.lit("<!-- page: "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), F.col("markdown")).alias("text"))
    return pages.groupBy("doc_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"])).alias("markdown"))


FRONT = ("document_id", "title", "tags", "pdf_title", "pdf_author", "pages", "edition", "canon_type", "ocr", "body_title")


def with_front_matter(docs: DataFrame, text_col: str = "markdown") -> DataFrame:
    """docs with markdown after a block of what is known of each: the columns of FRONT that docs has and that aren't null, lists in brackets."""

    def shown(c: str) -> Column:
        kind = docs.schema[c].dataType
        quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        if isinstance(kind, T.ArrayType):
            return F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, quoted)), F.lit("]"))
        return quoted(F.col(c)) if isinstance(kind, T.StringType) else F.col(c).cast("string")

    known = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), shown(c))) for c in FRONT if c in docs.columns]
    block = F.concat_ws("\n", F.lit("---"), *known, F.lit("---"), F.lit(""))
    return docs.withColumn(text_col, F.concat(block, F.lit("\n"), F.coalesce(text_col, F.lit(""))))


def markdown_of(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """document_id, markdown, status, error: each document's text; one whose object is missing has failed."""
    own = texts.select(F.col("document_id").alias("_d"), "markdown", F.lit(True).alias("_there"))
    found = documents.select("document_id").join(own, F.col("document_id") == F.col("_d"), "left")
    missing = F.col("_there").isNull()
    return found.select("document_id", "markdown", F.when(missing, "FAILED").otherwise("MARKDOWN_READY").alias("status"), F.when(missing, F.concat(F.lit("no Markdown object for "), "document_id")).alias("error"))


def body_title(lines: DataFrame) -> DataFrame:
    """doc_id, body_title: the only heading of the least level that a document has; null if there are more."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    heads = lines.select("doc_id", level.alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("title")).where("level > 0")
    best = heads.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.min("title").alias("title"))
    return best.groupBy("doc_id").agg(F.min_by(F.when(F.col("n") == 1, F.col("title")), "level").alias("body_title"))
