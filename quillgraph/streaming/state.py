"""The pipeline's state as an append-only log of rows (document_id, status, updated_at, ...) and its views; polling as streaming queries.

Views of an empty log are empty, its pages 0. A row without an id belongs to a document without one; a null time comes before any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("PENDING", "CONVERTING_PDF", "MARKDOWN_READY", "CLASSIFYING_SECTIONS", "EXTRACTING_ENTITIES", "MAPPING_TO_ONTOLOGY", "LOADING_GRAPH", "COMPLETED", "FAILED")
WAITING, DONE = ("PENDING", "MARKDOWN_READY"), ("COMPLETED", "FAILED")
PAGE, STALE_SECONDS, ERROR_CHARS, LEASE_SECONDS = 10, 600, 2000, 300


def latest(log: DataFrame) -> DataFrame:
    """The last row of each document; of rows with one time, the greatest."""
    rest = [c for c in log.columns if c != "document_id"]
    order = F.struct("updated_at", *[c for c in rest if c != "updated_at"])
    return log.groupBy("document_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("document_id", "r.*")


def get(log: DataFrame, document_id: str) -> DataFrame:
    return latest(log.where(F.col("document_id") == document_id))


def listed(log: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    return latest(log).orderBy("document_id").offset((page - 1) * size).limit(size)


def page_count(log: DataFrame, size: int = PAGE) -> DataFrame:
    return log.agg(F.ceil(F.countDistinct("document_id") / size).cast("long").alias("pages"))


def completed(log: DataFrame) -> DataFrame:
    return latest(log).where("status = 'COMPLETED'").orderBy(F.desc("updated_at"), "document_id")


def claimable(log: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """document_id of files that wait for conversion: unknown ones and pending ones, never failed ones."""
    now = latest(log).select("document_id", "status")
    if files is None:
        return now.where("status = 'PENDING'").select("document_id")
    return files.select("document_id").distinct().join(now, "document_id", "left").where("status is null or status = 'PENDING'").select("document_id")


def graph_candidates(log: DataFrame) -> DataFrame:
    """Documents for the graph stage, left-over ones in progress before fresh ones."""
    going = F.col("status").isin(*STATUSES[3:7])
    return latest(log).where(going | (F.col("status") == "MARKDOWN_READY")).orderBy(F.col("status") == "MARKDOWN_READY", "document_id")


def in_progress() -> Column:
    return ~F.col("status").isin(*WAITING, *DONE)


def stale(log: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    age = F.unix_timestamp(now.cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp_ntz").cast("timestamp"))
    return latest(log).where(in_progress()).where(age > seconds)


def claimed(candidates: DataFrame, claims: DataFrame, owner: str, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """Rows to append to the claims (document_id, owner, claimed_at, until): candidates that no one holds now."""
    free = candidates.select("document_id").distinct().join(held(claims, now), "document_id", "left_anti")
    return free.select("document_id", F.lit(owner).alias("owner"), now.alias("claimed_at"), F.timestamp_add("SECOND", F.lit(lease), now).alias("until"))


def held(claims: DataFrame, now: Column) -> DataFrame:
    """document_id, owner, until of claims that are in force: of two for one time the earlier one wins, then the smaller owner. A claim's later
    rows by its owner renew or release it."""
    by_owner = claims.where(F.col("claimed_at") <= now).groupBy("document_id", "owner").agg(F.min("claimed_at").alias("first"), F.max_by("until", F.struct("claimed_at", "until")).alias("until"), F.max(now).alias("_at"))
    live = by_owner.where(F.col("until") > F.col("_at"))
    return live.groupBy("document_id").agg(F.min_by(F.struct("owner", "until"), F.struct("first", "owner")).alias("c")).select("document_id", "c.*")


def renewed(claims: DataFrame, owner: str, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """Rows to append: an owner's claims in force hold longer. With a lease of 0 they are released; others' claims don't change."""
    own = held(claims, now).where(F.col("owner") == owner)
    return own.select("document_id", "owner", now.alias("claimed_at"), F.timestamp_add("SECOND", F.lit(lease), now).alias("until"))


def advanced(log: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows to append: documents' last rows with what `steps` (document_id, updated_at and any of the log's columns) says anew."""
    own = [c for c in steps.columns if c != "document_id"]
    new = steps.select(F.col("document_id").alias("_d"), *[F.col(c).alias(f"_{c}") for c in own])
    return latest(log).join(new, F.col("document_id") == F.col("_d")).select(*[F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c) for c in log.columns])


def failed(document_id: str, error: str, stage: str) -> dict:
    return {"document_id": document_id, "status": "FAILED", "error": error[:ERROR_CHARS], "last_successful_stage": stage}


def requeue(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Rows to append: failed documents of ids wait again; others don't change."""
    return latest(log).join(ids.select("document_id").distinct(), "document_id", "left_semi").where("status = 'FAILED'").withColumn("status", F.lit("PENDING")).withColumn("updated_at", at)


def restart(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Rows to append: known documents of ids wait again, whatever they did."""
    return latest(log).join(ids.select("document_id").distinct(), "document_id", "left_semi").withColumn("status", F.lit("PENDING")).withColumn("updated_at", at)


def progress() -> Column:
    part = lambda done, total: F.concat(F.coalesce(F.col(done).cast("string"), F.lit("0")), F.lit("/"), F.coalesce(F.col(total).cast("string"), F.lit("?")))
    return (
        F.when(F.col("status") == "CONVERTING_PDF", F.concat(F.lit("page "), part("current_page", "total_pages")))
        .when(F.col("status").isin("CLASSIFYING_SECTIONS", "EXTRACTING_ENTITIES"), F.concat(F.lit("chunk "), part("current_chunk", "total_chunks")))
        .when(F.col("status") == "COMPLETED", F.concat(F.coalesce(F.col("entity_count").cast("string"), F.lit("0")), F.lit(" entities")))
        .otherwise("")
    )


def type_assignments(folded: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """name, class, total (of all before the limit)."""
    rows = (folded if kind is None else folded.where(F.col("class") == kind)).select(F.replace("slug", F.lit("_"), F.lit(" ")).alias("name"), "class")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    out = rows.orderBy("name", "class")
    return (out if limit is None else out.limit(limit)).join(total)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log as a stream of new files."""
    return spark.readStream.schema(schema).parquet(path)


def watch(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "10 seconds"):
    """A poll loop: each micro-batch goes to `handle`; the checkpoint says what was handled. Where several drivers poll, `claimed` says whose a document is."""
    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def deduplicated(stream: DataFrame, id_cols: list[str], late: str = "10 minutes") -> DataFrame:
    """Events of a stream once each, for those that come within `late`."""
    return stream.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(id_cols)
