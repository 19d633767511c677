"""SimHash near-duplicates found by multi-index hashing.

A fingerprint has two 32-bit segments. If two fingerprints differ in 3 bits at most, then in one segment they differ in 1 bit at most,
so the ball of radius 1 around that segment (33 values) of the one holds the segment of the other. The 66 values of a fingerprint are
dealt out by value, and each complete distance inside a value's table is verified. Equal fingerprints count as one throughout.

A table that near copies crowd (over `crowd` entries) is not compared in pairs. Its members go to an index of points instead: if two
fingerprints differ in 3 bits at most, then some point lies within 1 bit of the one and within 2 bits, both in the same segment, of
the other; and whatever lies within 2 bits of a point that has a member within 1 bit is linked to that member. Each point links its
members to its smallest near member, so rows stay in proportion to the members.

Nulls: a null text counts as empty; an empty text's fingerprint is 0, linked like any other; rows whose id is null get a fingerprint
and no component. Repeated rows are kept. An empty table gives an empty table. Whole numbers are ids as longs, others (such as texts) as
they are: links connect fingerprints, so an id has only to be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import Cut, pieces, plain, ragged
from .components import connected_components

SEED = 42
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
RADIUS = 3
#: Entries of one table of the index that are compared in pairs at most.
CROWD = 2000
PIECE = 1 << 20
#: Ids of later copies that are broadcast at most; more are joined by a shuffle.
SMALL = 1_000_000


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of a byte array at once; slices of 32 bytes or more go to the xxhash library one by one."""
    out = np.empty(len(starts), dtype=np.uint64)
    long = lengths >= 32
    raw = data.tobytes()
    for i in np.flatnonzero(long).tolist():
        s = int(starts[i])
        out[i] = xxhash.xxh64_intdigest(raw[s : s + int(lengths[i])], seed)
    short = np.flatnonzero(~long)
    short = short[np.argsort(lengths[short].astype(np.uint8), kind="stable")]
    at, n = starts[short].copy(), lengths[short].astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words8 = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    words4 = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + P5 + n.astype(np.uint64)
        for r in range(3):
            a = np.searchsorted(n, 8 * (r + 1))  # sorted by length: the rest has another lane
            k = _rotl(words8[at[a:]] * P2, 31) * P1
            h[a:] = _rotl(h[a:] ^ k, 27) * P1 + P4
            at[a:] += 8
        w = np.flatnonzero(n & 4)
        h[w] = _rotl(h[w] ^ (words4[at[w]].astype(np.uint64) * P1), 23) * P2 + P3
        at[w] += 4
        for r in range(3):
            w = np.flatnonzero((n & 3) > r)
            h[w] = _rotl(h[w] ^ (padded[at[w]].astype(np.uint64) * P5), 11) * P1
            at[w] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    out[short] = h
    return out


def _lanes() -> np.ndarray:
    """For each byte, its 8 bits as 8 counters of 8 bits."""
    b = np.arange(256, dtype=np.uint64)
    return sum(((b >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


_LANES = _lanes()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the bits that over half of them have; 0 for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    parts = -(-counts // 255)  # counters of 8 bits hold 255 hashes
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = np.repeat(first, parts) + 255 * ragged(np.zeros(len(parts), dtype=np.int64), parts)
    run = np.concatenate([[0], np.cumsum(parts)[:-1]])
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        sums = np.add.reduceat(_LANES[octets[:, j]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_ = 2 * np.add.reduceat(sums, run, axis=0) > counts[:, None]
        out[full] |= np.packbits(set_, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints_of(texts: pa.Array, width: int = 3) -> np.ndarray:
    """Fingerprints of whole texts: A-Z lowered, words between ASCII white space, shingles of `width` words, repeats included."""
    parts = pc.ascii_split_whitespace(plain(texts))
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    sizes = np.asarray(pc.binary_length(flat), dtype=np.int64)
    full = sizes > 0
    seen = np.concatenate([[0], np.cumsum(full)])
    first = seen[offsets]  # of the words that aren't empty
    n_words = np.diff(first)
    raw = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    start = int(np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset]) if len(flat) else 0
    sizes = sizes[full]
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    data = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)  # all words, a space after each
    text = np.ones(len(data), dtype=bool)
    text[ends] = False
    data[text] = raw[start : start + int(sizes.sum())]
    data[(data >= ord("A")) & (data <= ord("Z"))] += 32  # no byte of a longer UTF-8 character is in this range
    shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    at = ragged(first[:-1], shingles)
    last = at + np.repeat(np.minimum(np.maximum(n_words, 1), width) - 1, shingles)
    out = np.empty(len(at), dtype=np.uint64)
    for s in range(0, len(at), PIECE):
        b, e = begins[at[s : s + PIECE]], ends[last[s : s + PIECE]]
        low, high = int(b.min()), int(e.max())
        out[s : s + PIECE] = xxh64(data[low:high], b - low, e - b)
    return majority(out, shingles)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """i (the id: a long for whole numbers, else of its own type), fp (long, the 64 bits as a signed number), for each row."""
    kind = docs.schema[id_col].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                fp = fingerprints_of(part.column("t"), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(fp)], names=["i", "fp"])

    return docs.select(F.col(id_col).cast(kind).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField("i", kind), T.StructField("fp", T.LongType())]))


def _masks(bits: int) -> list[int]:
    return [0, *(1 << i for i in range(bits))]


def probes(classes: DataFrame) -> DataFrame:
    """key, fp, rep, own: the 66 values of each fingerprint; own marks its two segments themselves."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    mark = F.lit(1 << 33)
    values = [F.struct(high.bitwiseXOR(F.lit(m)).alias("key"), F.lit(m == 0).alias("own")) for m in _masks(32)]
    values += [F.struct(low.bitwiseXOR(F.lit(m)).bitwiseOR(mark).alias("key"), F.lit(m == 0).alias("own")) for m in _masks(32)]
    return classes.select("fp", "rep", F.explode(F.array(*values)).alias("p")).select("p.key", "fp", "rep", "p.own")


def crowded(classes: DataFrame, crowd: int) -> DataFrame:
    """key: the tables of the index that may have over `crowd` entries; none with over twice as many is missing.

    Counted from the segments themselves: only those with over crowd/33 fingerprints are spread to their neighbours.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 33))
    held = classes.select(F.explode(F.array(F.shiftrightunsigned("fp", 32), low)).alias("key")).groupBy("key").count().where(F.col("count") > crowd // 33)
    near = held.select(F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(m)) for m in _masks(32)])).alias("key"), "count")
    return near.groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") > crowd).select("key")


def _forest(fp: np.ndarray, rep: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the members of one table as all its links would."""
    e = np.flatnonzero(own)
    near = np.bitwise_count(fp[e][:, None] ^ fp[None, :]) <= RADIUS
    label = rep.copy()
    while True:
        to_e = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = label.copy()
        new[e] = np.minimum(label[e], to_e)
        back = np.where(near, new[e][:, None], np.iinfo(np.int64).max).min(axis=0)
        new = np.minimum(new, back)
        if (new == label).all():
            break
        label = new
    w = label != rep
    return rep[w], label[w]


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the tables of sorted, complete keys."""
    cut = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    size = ends - starts
    has = np.add.reduceat(own.astype(np.int64), starts) > 0
    out_a, out_b = [], []
    small = has & (size > 1) & (size <= 4)
    for d in (1, 2, 3):
        w = small & (size > d)
        i = ragged(starts[w], size[w] - d)
        ok = np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS
        out_a.append(rep[i[ok]])
        out_b.append(rep[i[ok] + d])
    for s, e in zip(starts[has & (size > 4)].tolist(), ends[has & (size > 4)].tolist(), strict=True):
        a, b = _forest(fp[s:e], rep[s:e], own[s:e])
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: links of each table, which may span batches."""
    held: list[np.ndarray] | None = None

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _links(*cols)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        cols = [batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        end = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[end:] for c in cols]
        if end:
            yield found([c[:end] for c in cols])
    if held is not None:
        yield found(held)


def _point_links(members: DataFrame) -> DataFrame:
    """Links of the members of crowded tables, by the points near them."""
    flips1 = [1 << i for i in range(64)]
    flips2 = [(1 << i) | (1 << j) for h in (0, 32) for i in range(h, h + 32) for j in range(h, i)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    near = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(m))) for m in [0, *flips1]])).alias("point")
    far = F.explode(F.transform(F.lit([signed(m) for m in flips2]), lambda m: F.col("fp").bitwiseXOR(m))).alias("point")
    one = members.select(near, "rep")
    centre = one.groupBy("point").agg(F.min("rep").alias("centre")).select(F.col("point").bitwiseXOR(F.lit(0).cast("long")).alias("k"), "centre")
    points = one.unionByName(members.select(far, "rep"))
    return points.join(centre, points.point == centre.k).where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()


def links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: enough links between classes (fp, rep) to connect whatever links of 3 bits at most connect."""
    spark = classes.sparkSession
    hot = Cut(crowded(classes, crowd), "crowded")
    all_probes = probes(classes)
    n_hot = hot.df.count()
    if n_hot:
        side = F.broadcast(hot.df) if n_hot <= 100_000 else hot.df
        members = Cut(all_probes.join(side, "key", "left_semi").select("fp", "rep").distinct(), "crowd")
        all_probes = all_probes.join(side, "key", "left_anti")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = all_probes.repartition(n, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_tables, "a long, b long")
    if n_hot:
        found = found.unionByName(_point_links(members.df))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = CROWD) -> DataFrame:
    """A row per input row: id, fp (long), component (smallest id that links reach, its own included)."""
    fps = Cut(fingerprints(docs, id_col, text_col, width), "fingerprints").df
    classes = Cut(fps.where("i is not null").groupBy("fp").agg(F.min("i").alias("first")), "classes").df
    comps = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), crowd)).df
    comps = comps.unionByName(comps.select(F.col("component").alias("node"), "component").distinct())  # the smallest nodes themselves
    linked = classes.join(comps, classes.fp == comps.node).select("node", "first", F.col("component").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component")).select(F.col("root").bitwiseXOR(F.lit(0).cast("long")).alias("r"), "component")
    reached = linked.join(least, linked.root == least.r).select("node", "component")
    of_class = classes.join(reached, classes.fp == reached.node, "left").select(F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("k"), F.coalesce("component", "first").alias("component"))
    out = fps.join(of_class, fps.fp == of_class.k, "left")
    return out.select(F.col("i").alias(id_col), "fp", F.when(F.col("i").isNotNull(), F.col("component")).alias("component"))


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The rows of docs whose id is their component's smallest; rows without an id stay. Columns as in docs."""
    found = near_duplicates(docs, id_col, text_col).where(F.col("component") < F.col(id_col)).select(F.col(id_col).alias("_later")).distinct()
    later = Cut(found, "later").df
    side = F.broadcast(later) if later.count() <= small else later
    return docs.join(side, docs[id_col] == later["_later"], "left_anti")
