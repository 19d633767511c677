"""Graph tables in Parquet, N-Quads files, and tables cut from their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUADS = "doc_id string, s string, p string, o string, o_kind string, datatype string"


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder until the driver's JVM ends: no lineage, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    p, files = _files(df.sparkSession, path)
    files.deleteOnExit(p)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_quads(quads: DataFrame, path: str) -> DataFrame:
    """One folder for each document; a document written again replaces what it had before. Gives doc_id, subjects and triples as written."""
    rows = cut(quads)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)
    return rows.groupBy("doc_id").agg(F.countDistinct("s").alias("subjects"), F.count("*").alias("triples"))


def drop_document(spark: SparkSession, path: str, doc_id: str) -> None:
    p, files = _files(spark, f"{path}/doc_id={doc_id}")
    files.delete(p, True)


def triples(quads: DataFrame) -> DataFrame:
    """The union of all documents' graphs as a set."""
    return quads.select("s", "p", "o", "o_kind", "datatype").dropDuplicates()


#: What a literal's characters are written as; the backslash first.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def _escaped(c):
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def _unescaped(c):
    """Pairs of backslashes are set aside first, so that one before an n isn't taken for half of a line end."""
    c = F.replace(c, F.lit(ESCAPES[0][1]), F.lit("\0"))
    for plain, written in ESCAPES[1:]:
        c = F.replace(c, F.lit(written), F.lit(plain))
    return F.replace(c, F.lit("\0"), F.lit("\\"))


def quad_lines(quads: DataFrame) -> DataFrame:
    lit = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.when(F.col("datatype") == "integer", F.lit("^^<http://www.w3.org/2001/XMLSchema#integer>")).otherwise(""))
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(lit)
    return quads.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" <"), "doc_id", F.lit("> .")).alias("value"))


def export_nquads(quads: DataFrame, path: str) -> None:
    quad_lines(quads).write.mode("overwrite").option("compression", "gzip").text(path)


#: Without a way back inside a literal, however long it is. Its parts are s, p, o of an IRI, o of a literal, datatype, doc_id.
FORM = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*)>)?) <([^>]*)> \.(?:\r\n|[\n\r\u0085\u2028\u2029])?$'
#: A line's parts with ">" between them, which no IRI holds, and the literal last. A comment's mark is before them: no other line begins with one.
PARTS = "#$6>$1>$2>$3>$5>$4"


def parse_nquads(lines: DataFrame) -> DataFrame:
    """Quads of lines; blank lines and comments are passed over. A line of another form fails the job: nothing is left out silently."""
    value = F.trim("value")
    bad = F.raise_error(F.concat(F.lit("no N-Quads line: "), F.substring("value", 1, 200)))
    rows = lines.select(value.alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select("value", F.regexp_replace("value", FORM, PARTS).alias("line"))
    rows = rows.select(F.when(F.startswith("line", F.lit("#")), F.split(F.substring("line", 2, 2147483647), ">", 6)).otherwise(bad.cast("array<string>")).alias("x"))
    part = lambda k: F.col("x")[k]
    iri = part(3) != ""
    return rows.select(
        part(0).alias("doc_id"), part(1).alias("s"), part(2).alias("p"), F.when(iri, part(3)).otherwise(_unescaped(part(5))).alias("o"), F.when(iri, "iri").otherwise("lit").alias("o_kind"), F.when(part(4).endswith("#integer"), "integer").when(~iri, "string").alias("datatype")
    )


def import_nquads(spark: SparkSession, path: str, target: str, version: str, own_version: str) -> bool:
    """A backup's quads into the store at target, if its major and minor version are ours. False if this backup is there already; a store that
    holds anything else is refused."""
    if version.split(".")[:2] != own_version.split(".")[:2]:
        raise ValueError(f"backup version {version} does not fit {own_version}")
    mark, files = _files(spark, f"{target}/_backup")
    if files.exists(mark):
        if [tuple(r) for r in spark.read.parquet(mark.toString()).collect()] == [(path, version)]:
            return False
        raise ValueError("the target store holds another backup")
    if files.exists(mark.getParent()) and len(files.listStatus(mark.getParent())):
        raise ValueError("the target store isn't empty")
    write_quads(parse_nquads(spark.read.text(path)), target)
    spark.createDataFrame([(path, version)], "path string, version string").coalesce(1).write.parquet(mark.toString())
    return True
