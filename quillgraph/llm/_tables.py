"""What the operators share: table paths, lineage cuts in the shared folder, Arrow batches in bounded pieces."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are held as one piece inside a Python worker.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


_SCOPES: list[list[Cut]] = []


class Cut:
    """A table written to the shared folder: it survives lost executors and ends the lineage.

    It is deleted by drop(), at the end of a scope(), or else when the driver's JVM ends.
    """

    def __init__(self, df: DataFrame, name: str = "cut"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self._files()[1].deleteOnExit(self._files()[0])
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def _files(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        p, files = self._files()
        files.delete(p, True)


@contextmanager
def scope() -> Iterator[list[Cut]]:
    """Cuts made inside are dropped at the end, but for those that are taken out of the list."""
    own: list[Cut] = []
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)
        for cut in own:
            cut.drop()


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes (whose lists have so many values); a longer one is a slice of its own."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    sizes = np.asarray(pc.fill_null(length(values), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def plain(texts: pa.Array) -> pa.Array:
    """A copy as large strings, nulls as empty texts. It begins at the first row of its own buffers: kernels misread some casts of slices."""
    texts = texts.cast(pa.string()) if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)) else texts
    copied = pa.concat_arrays([texts, pa.array([""], texts.type)])  # of one array it would give that array
    return pc.fill_null(copied, "").cast(pa.large_string()).slice(0, len(texts))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words between ASCII white space: a code for each word, the first code of each text (one more at the end), and the distinct words.

    A null text has no words.
    """
    parts = pc.ascii_split_whitespace(plain(texts))
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)  # white space at either end leaves empty parts
    seen = np.concatenate([[0], np.cumsum(full)])
    found = flat.filter(pa.array(full)).dictionary_encode()
    return np.asarray(found.indices, dtype=np.int64), seen[offsets], found.dictionary


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As coded(), with the distinct words as a list."""
    codes, first, distinct = coded(texts)
    return codes, first, in_lines(distinct).split("\n") if len(distinct) else []


def in_lines(values: pa.Array) -> str:
    """Large strings without nulls, a line end between two."""
    if not len(values):
        return ""
    data, offsets = bytes_of(pc.binary_join_element_wise(values, pa.scalar("", values.type), pa.scalar("\n", values.type)))
    return data[offsets[0] : offsets[-1] - 1].tobytes().decode()


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings or binaries without nulls, and where each value's begin (one more at the end)."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8), offsets


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0] ... starts[0]+counts[0]-1, starts[1] ... as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
