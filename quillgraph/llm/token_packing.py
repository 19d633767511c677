"""Token ids packed into rows of one length by best-fit decreasing, over the whole table.

Each text's ids and an end token are a piece, or several pieces of the row's length and a rest if they are longer; nothing is dropped.
Pieces are taken longest first. A segment tree over capacities finds the open row with the least room that still holds the piece;
if there is none, a row is opened. A row holds its ids (padded), the cumulative lengths of its segments, and each segment's text, place in
the text and position at which its counting starts again (0; a continued text's positions go on if `restart` is false).

Which row a piece goes to depends on its length alone. So the texts are encoded once and written as pieces; only how many pieces there are
of each length, row_length numbers at most, comes to the driver. There rows that are filled alike are one group in the tree, however many
they are, and pieces of one length go to a group at once. A piece finds its row by its rank among those of its length, which is made from
counts by task and length; one shuffle then brings each row's pieces together. How full the rows are doesn't depend on the partitions.

Nulls: a null or empty text is one piece with the end token only; null ids are kept; repeated rows are packed like any other; an empty table
gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._tables import Cut, pieces, ragged

LENGTH = 2048
#: Counts by task and length that are broadcast at most (24 bytes each); more are joined by a shuffle.
SMALL = 1_000_000


class Capacities:
    """A segment tree over the capacities 0 to `most`: how many groups of open rows have that much room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def put(self, room: int, group: tuple[int, int]) -> None:
        self.groups[room].append(group)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, tuple[int, int]] | None:
        """The smallest room of `least` or more and, of the groups with it, the last one that was put there."""
        k, count = least + self.size, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.groups[room].pop()


def plan(counts: dict[int, int], row_length: int) -> list[tuple[int, int, int, int, int]]:
    """Places for counts[n] pieces of each length n: (n, rank, row, each, offset) says that the pieces of length n from `rank` on, up to the
    next such rank, go to the rows from `row` on, `each` to a row, and stand there from `offset` on.

    A group is a range of rows with equal room. Of one length, a row takes as many as fit before the next row, as one piece after the other would.
    """
    out, rows = [], 0
    tree = Capacities(row_length)
    for n, left in sorted(counts.items(), reverse=True):
        rank = 0
        while left:
            got = tree.take(n)
            if got is None:
                more = -(-left // (row_length // n))
                got, rows = (row_length, (rows, rows + more)), rows + more
            room, (low, high) = got
            each = room // n
            full = min(high - low, left // each)
            for each, k in ((each, full), (left - full * each, 1 if full < high - low else 0)):
                if not each or not k:
                    continue
                out.append((n, rank, low, each, row_length - room))
                rank, left = rank + k * each, left - k * each
                if room > n * each:
                    tree.put(room - n * each, (low, low + k))
                low += k
            if low < high:
                tree.put(room, (low, high))
    return out


def cut_pieces(docs: DataFrame, row_length: int, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """i, start, n, ids of each piece, part (its task) and k (its rank among the pieces of its length of that task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.model(path or bpe.default_path())
        end = model.special.get("<|endoftext|>", 0)
        kind = _kind(model)
        seen = np.zeros(row_length + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "t"):
                flat, offsets = bpe.flatten(*model.encode_batch(part.column("t")))
                flat = np.insert(flat, offsets[1:], end).astype(kind)
                lengths = np.diff(offsets) + 1
                parts = -(-lengths // row_length)
                of = np.repeat(np.arange(len(lengths)), parts)
                start = row_length * ragged(np.zeros(len(parts), dtype=np.int64), parts)
                n = np.minimum(row_length, lengths[of] - start)
                order = np.argsort(n, kind="stable")
                first = np.searchsorted(n[order], n[order])
                k = np.empty(len(n), dtype=np.int64)
                k[order] = np.arange(len(n)) - first + seen[n[order]]
                seen += np.bincount(n, minlength=row_length + 1)
                at = pa.py_buffer((bpe.firsts(n) * kind.itemsize).astype(np.int32))
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, at, pa.py_buffer(flat)])
                cols = [part.column("i").take(pa.array(of)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(k), pa.array(np.full(len(n), task), pa.int32()), ids]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "start", "n", "k", "part", "ids"])

    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    fields = [own.schema["i"], *[T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("n", T.IntegerType()), ("k", T.LongType()), ("part", T.IntegerType()), ("ids", T.BinaryType()))]]
    return own.mapInArrow(run, T.StructType(fields))


def _kind(model: bpe.WordBpe) -> np.dtype:
    return np.dtype("<u2") if model.size <= 1 << 16 else np.dtype("<u4")


def packed(docs: DataFrame, row_length: int = LENGTH, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", restart: bool = True) -> DataFrame:
    """Packed rows: row, ids (row_length little-endian integers of 16 bits, or 32 for larger vocabularies), n_tokens without
    padding, cu_seqlens, and for each segment its id, first token in the text and first position; ids_sha256 of the ids' bytes."""
    if row_length < 1:
        raise ValueError("row_length must be 1 or more")
    spark = docs.sparkSession
    made = Cut(cut_pieces(docs, row_length, path, id_col, text_col), "pieces").df
    counts = made.groupBy("part", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = Cut(counts.select("part", "n", "c", F.coalesce(before, F.lit(0)).alias("before")), "counts").df
    total = {r["n"]: r["c"] for r in counts.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # row_length rows at most
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, *place in plan(total, row_length):
        by_length.setdefault(n, []).append(tuple(place))
    places = spark.createDataFrame(sorted(by_length.items()), "n int, places array<struct<rank: long, row: long, each: long, offset: int>>")
    small = F.broadcast if counts.count() <= SMALL else lambda df: df
    held = made.join(small(counts.select("part", "n", "before")), ["part", "n"]).join(F.broadcast(places), "n")
    rank = F.col("before") + F.col("k")
    held = held.select("i", "start", "n", "ids", rank.alias("rank"), F.element_at(F.filter("places", lambda p: p["rank"] <= rank), -1).alias("p"))
    since = F.col("rank") - F.col("p.rank")
    row = F.col("p.row") + F.floor(since / F.col("p.each"))
    at = F.col("p.offset") + F.pmod(since, F.col("p.each")) * F.col("n")
    held = held.select("i", "start", "n", "ids", row.cast("long").alias("row"), at.cast("int").alias("at"))
    dealt = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").sortWithinPartitions("row", "at")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.model(path or bpe.default_path())
        pad = np.array([model.special.get("<|endoftext|>", 0)], dtype=_kind(model)).tobytes()
        rest: pa.Table | None = None

        def rows_of(table: pa.Table) -> pa.RecordBatch:
            row, n = np.asarray(table["row"]), np.asarray(table["n"])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
            parts, ends = table["ids"].to_pylist(), bpe.firsts(n)
            out_ids, cu = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                data = b"".join(parts[a:b])
                out_ids.append(data + pad * (row_length - len(data) // len(pad)))
                cu.append(ends[a : b + 1] - ends[a])
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values.combine_chunks().cast(kind) if isinstance(values, pa.ChunkedArray) else values)
            starts = table["start"].combine_chunks()
            cols = [
                pa.array(row[cuts[:-1]], pa.int64()),
                pa.array(out_ids, pa.binary()),
                pa.array([int(c[-1]) for c in cu], pa.int32()),
                pa.array(cu, pa.list_(pa.int32())),
                lists(table["i"], table["i"].type),
                lists(starts, pa.int32()),
                lists(pa.array(np.zeros(len(starts)), pa.int32()) if restart else starts, pa.int32()),
                pa.array([hashlib.sha256(x).hexdigest() for x in out_ids], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["row", "ids", "n_tokens", "cu_seqlens", "doc_ids", "starts", "position_starts", "ids_sha256"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not len(table):
                continue
            row = np.asarray(table["row"])
            end = int(np.searchsorted(row, row[-1]))
            rest = table.slice(end)
            if end:
                yield rows_of(table.slice(0, end))
        if rest is not None and len(rest):
            yield rows_of(rest)

    fields = [("row", T.LongType()), ("ids", T.BinaryType()), ("n_tokens", T.IntegerType()), ("cu_seqlens", T.ArrayType(T.IntegerType())), ("doc_ids", T.ArrayType(kind)), ("starts", T.ArrayType(T.IntegerType())), ("position_starts", T.ArrayType(T.IntegerType())), ("ids_sha256", T.StringType())]
    return dealt.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in fields]))


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as a table of binary matrices: each file's `ids` column is its matrix, row after row."""
    rows.write.mode("overwrite").parquet(path)


def matrix(rows: list, row_length: int = LENGTH, kind: str = "<u2") -> np.ndarray:
    """The id matrix of collected or read rows."""
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype=kind).reshape(-1, row_length)
