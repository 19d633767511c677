"""Embedding near-duplicates by tiles of int8 products with an error bound for each vector.

Vectors are compared only inside a label. A vector of length 1 is stored as q * s with q of 8-bit integers; r is the exact length of what
the rounding left over and a the length of q * s. For two vectors the cosine differs from s * s' * (q . q') by a * r' + r * a' + r * r' at
most, so only pairs whose product plus that bound reaches the threshold are computed again in double precision. Products of a
tile of vectors with another are one matrix product; float32 holds these integer sums exactly up to 1040 dimensions, beyond that float64 is used.

Equal vectors of a label count as one with a weight. Vectors are put into tiles by the signs of fixed projections, so tiles are narrow
where vectors cluster. Pairs of tiles are passed over in three steps, each with less data than the next: by a table of centres and radii, those
whose centres are further apart than both radii and the threshold's angle; by the 8-bit codes and bounds alone, those without a product that may
reach the threshold; only for the others the doubles are fetched. A pair of tiles gives each vector its number of links and enough edges to
connect what its links connect: never the pairs themselves.

Nulls: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label or id, link with nothing.
Vectors of different lengths link with nothing. Rows are counted one by one: a repeated row is a vector of its own. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Cut
from .components import connected_components

TILE = 1024
SLACK = 1e-9
PLANES = 12
#: Tiles whose centres are broadcast at most (a number for each dimension); more are joined by a shuffle.
SMALL = 10_000


def keyed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """i, label, key (the doubles as bytes, null if the vector can't link), place (signs of fixed projections)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [], []
            for ok, v in zip(batch.column("ok").to_pylist(), batch.column("v"), strict=True):
                x = np.array(v.values, dtype=np.float64) + 0.0 if ok and v.is_valid and not v.values.null_count else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                if not top or not np.isfinite(top) or np.isnan(x).any():
                    keys.append(None)
                    places.append(0)
                    continue
                keys.append(x.tobytes())
                signs = _planes(len(x)) @ x > 0
                places.append(int(signs @ (1 << np.arange(PLANES))))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(places, pa.int64())], names=["i", "label", "key", "place"])

    ok = F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    return vectors.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), ok.alias("ok")).mapInArrow(run, "i long, label string, key binary, place long")


_PLANES: dict[int, np.ndarray] = {}


def _planes(dim: int) -> np.ndarray:
    if dim not in _PLANES:
        _PLANES[dim] = np.random.default_rng(dim).standard_normal((PLANES, dim))
    return _PLANES[dim]


def tiles(classes: DataFrame, size: int) -> DataFrame:
    """label, dim, tile, ids, weights, data: classes in tiles of `size` or so, near ones together.

    The place in its label and dimension is found from counts of (label, dim, place), so no label is sorted in one task.
    """
    counts = classes.groupBy("label", "dim", "place").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("label", "dim").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("label", "dim", "place", "n", F.coalesce(before, F.lit(0)).alias("start"))  # at most 2 ** PLANES rows a label
    first = F.floor(F.col("start") / size).cast("long")
    span = F.greatest(F.lit(1), F.ceil((F.col("start") % size + F.col("n")) / size)).cast("long")
    placed = classes.join(starts.select("label", "dim", "place", first.alias("first"), span.alias("span")), ["label", "dim", "place"])
    tile = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("span"))
    return placed.groupBy("label", "dim", tile.alias("tile")).agg(F.sort_array(F.collect_list(F.struct("rep", "n", "key"))).alias("rows"))


def _unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, weights = np.array(rows.field("rep"), dtype=np.int64), np.array(rows.field("n"), dtype=np.int64)
    return ids, weights, np.frombuffer(b"".join(rows.field("key").to_pylist()), dtype=np.float64).reshape(len(ids), -1)


class Tile:
    def __init__(self, rows: pa.StructArray):
        self.ids, self.weights, self.x = _unpacked(rows)
        scale = np.abs(self.x).max(axis=1, keepdims=True)
        part = self.x / scale
        self.unit = part / np.sqrt((part * part).sum(axis=1, keepdims=True))
        self.s = np.abs(self.unit).max(axis=1) / 127
        q = np.rint(self.unit / self.s[:, None])
        self.q = q.astype(np.int8)
        self.r = np.sqrt(((self.unit - q * self.s[:, None]) ** 2).sum(axis=1))
        self.a = self.s * np.sqrt((q * q).sum(axis=1))
        centre = self.unit.sum(axis=0)
        size = np.sqrt(centre @ centre)
        self.centre = centre / size if size else None
        self.radius = float(np.arccos(np.clip(self.unit @ self.centre, -1, 1)).max()) if size else np.pi


def products(a, b) -> np.ndarray:
    """Upper bounds of the cosines of two tiles' vectors from their codes."""
    kind = np.float32 if a.q.shape[1] <= 1040 else np.float64
    product = (a.q.astype(kind) @ b.q.astype(kind).T).astype(np.float64)
    product *= a.s[:, None]
    product *= b.s[None, :]
    product += a.a[:, None] * b.r[None, :] + a.r[:, None] * (b.a + b.r)[None, :]
    return product


@dataclass
class Codes:
    q: np.ndarray
    s: np.ndarray
    r: np.ndarray
    a: np.ndarray

    @classmethod
    def read(cls, codes: bytes, scales: bytes) -> Codes:
        s, r, a = np.frombuffer(scales, dtype=np.float64).reshape(3, -1)
        return cls(np.frombuffer(codes, dtype=np.int8).reshape(len(s), -1), s, r, a)


def coded(made: DataFrame) -> DataFrame:
    """label, dim, tile, centre (null if the vectors have none), radius, codes, scales of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = Tile(batch.column("rows")[k].values)
                own = [pa.array([None if t.centre is None else t.centre.tolist()], pa.list_(pa.float64())), pa.array([t.radius]), pa.array([t.q.tobytes()], pa.binary()), pa.array([np.stack([t.s, t.r, t.a]).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in ("label", "dim", "tile")], *own], names=["label", "dim", "tile", "centre", "radius", "codes", "scales"])

    return made.mapInArrow(run, f"label string, dim {made.schema['dim'].dataType.simpleString()}, tile long, centre array<double>, radius double, codes binary, scales binary")


def near_tiles(tiles: DataFrame, least: float) -> DataFrame:
    """label, dim, tile, other (not before tile) that aren't too far apart, from their centres and radii alone."""
    names = tiles.select("label", "dim", "tile", "centre", "radius")
    others = tiles.select("label", "dim", F.col("tile").alias("other"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"))
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    near = F.col("centre").isNull() | F.col("centre2").isNull() | (apart <= F.col("radius") + F.col("radius2") + float(np.arccos(least)) + 1e-6)
    if tiles.count() <= SMALL:  # so a label that holds most tiles is dealt out by its tiles
        names, others = names.repartition("label", "dim", "tile"), F.broadcast(others)
    return names.join(others, ["label", "dim"]).where((F.col("tile") == F.col("other")) | ((F.col("tile") < F.col("other")) & near)).select("label", "dim", "tile", "other")


def _possible(least: float):
    """Which pairs of tiles have a product that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b = (Codes.read(batch.column(f"codes{n}")[k].as_py(), batch.column(f"scales{n}")[k].as_py()) for n in (1, 2))
                keep.append(bool((products(a, b) >= least - SLACK).any()))
            names = ["label", "dim", "tile", "other"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    return run


def linked(a: Tile, b: Tile, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the pairs that link."""
    product = products(a, b)
    i, j = np.nonzero(product >= least - SLACK)
    if len(i):
        ok = np.concatenate([np.einsum("nd,nd->n", a.unit[i[k : k + 65536]], b.unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= least
        i, j = i[ok], j[ok]
    return i, j


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links u-v connect, each node to a smaller one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    w = label != np.arange(len(nodes))
    return nodes[w], nodes[label[w]]


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, Tile] | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k] for c in ("left", "right"))
                name = tuple(batch.column(c)[k].as_py() for c in ("label", "dim", "tile"))
                if held is None or held[0] != name:
                    held = (name, Tile(left.values))
                same = batch.column("other")[k].as_py() == name[2]
                a = held[1]
                b = a if same else Tile(right.values)
                i, j = linked(a, b, least)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                n_a = np.bincount(i, weights=b.weights[j], minlength=len(a.ids)).astype(np.int64)
                n_b = np.bincount(j, weights=a.weights[i], minlength=len(b.ids)).astype(np.int64)
                u, v = _forest(a.ids[i], b.ids[j])
                ids = np.concatenate([a.ids[n_a > 0], b.ids[n_b > 0], u])
                n = np.concatenate([n_a[n_a > 0], n_b[n_b > 0], np.zeros(len(u), dtype=np.int64)])
                to = pa.array(np.concatenate([np.zeros((n_a > 0).sum() + (n_b > 0).sum(), dtype=np.int64), v]), mask=np.concatenate([np.ones((n_a > 0).sum() + (n_b > 0).sum(), dtype=bool), np.zeros(len(u), dtype=bool)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), to], names=["rep", "n", "to"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """A row per input row: id, n_links (other rows with cosine >= least and the same label), component_id, kept (id = component_id)."""
    spark = vectors.sparkSession
    rows = Cut(keyed(vectors, id_col, vec_col, label_col), "vectors").df
    able = rows.where("key is not null")
    classes = Cut(able.groupBy("label", "key").agg(F.min("i").alias("rep"), F.count("*").alias("n"), F.first("place").alias("place")).withColumn("dim", F.length("key") / 8), "classes").df
    made = Cut(tiles(classes, tile), "tiles").df
    tiles_ = Cut(coded(made), "codes").df
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = Cut(near_tiles(tiles_, least), "pairs").df
    side = lambda k: tiles_.select("label", "dim", F.col("tile").alias("tile" if k == 1 else "other"), F.col("codes").alias(f"codes{k}"), F.col("scales").alias(f"scales{k}"))
    both = pairs.where("tile <> other").join(side(1), ["label", "dim", "tile"]).join(side(2), ["label", "dim", "other"]).select("label", "dim", "tile", "other", "codes1", "scales1", "codes2", "scales2")
    schema = pairs.select("label", "dim", "tile", "other").schema
    able_pairs = both.repartition(n, "label", "dim", "tile", "other").mapInArrow(_possible(least), schema)
    pairs = Cut(able_pairs.unionByName(pairs.where("tile = other")), "pairs").df
    work = pairs.join(made.withColumnRenamed("rows", "left"), ["label", "dim", "tile"])
    work = work.join(made.select("label", "dim", F.col("tile").alias("other"), F.col("rows").alias("right")), ["label", "dim", "other"])
    found = Cut(work.select("label", "dim", "tile", "other", "left", F.when(F.col("tile") != F.col("other"), F.col("right")).alias("right")).repartition(n, "label", "dim", "tile", "other").mapInArrow(_compare(least), "rep long, n long, to long"), "found").df
    counts = found.where("to is null").groupBy("rep").agg(F.sum("n").alias("more"))
    comps = connected_components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b"))).df
    judged = classes.join(counts, "rep", "left").join(comps, classes.rep == comps.node, "left")
    judged = judged.select(F.concat("label", F.lit("")).alias("l"), F.col("key").alias("k"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = able.join(judged, (able.label == judged.l) & (able.key == judged.k)).select(F.col("i"), "n_links", "component_id")
    rest = rows.where("key is null").select("i", F.lit(0).cast("long").alias("n_links"), F.col("i").alias("component_id"))
    out = done.unionByName(rest)
    return out.select(F.col("i").alias(id_col), "n_links", "component_id", F.coalesce(F.col("i") == F.col("component_id"), F.lit(False)).alias("kept"))
